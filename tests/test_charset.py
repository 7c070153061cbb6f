import pytest
from pyspark.sql import functions as F

from weftline.functions import charset
from weftline.plans import queries_more

RU = "Съешь же ещё этих мягких французских булок, да выпей чаю. Это обычный русский текст о погоде и природе, который написан для проверки."
EL = "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί. Αυτό είναι ένα απλό κείμενο στα ελληνικά για τη δοκιμή."
JA = "これは日本語の文章です。文字コードを見分けるために書かれています。東京の天気は晴れで、気温は二十度です。"
ZH = "这是一个用来测试编码检测的中文文本。今天的天气很好，我们去公园散步吧。"
TW = "這是一個用來測試編碼偵測的中文文本。今天的天氣很好，我們去公園散步吧。"
KO = "이것은 인코딩 감지를 시험하기 위한 한국어 문장입니다. 오늘은 날씨가 아주 좋습니다."
FR = "Voilà déjà l'été : les élèves français préfèrent être à la plage, où ça sent la crème brûlée et le café."
CS = "Příliš žluťoučký kůň úpěl ďábelské ódy; česká věta s háčky a čárkami pro zkoušku kódování."


@pytest.mark.parametrize(
    "text, name",
    [(RU, "windows-1251"), (RU, "koi8-r"), (RU, "iso-8859-5"), (EL, "iso-8859-7"), (JA, "shift_jis"), (JA, "euc-jp"), (JA, "iso2022_jp"), (ZH, "gb18030"), (TW, "big5"), (KO, "euc-kr"), (FR, "cp1252"), (CS, "cp1250"),
     (RU, "utf-8"), (FR, "utf-8-sig"), (FR, "utf-16-le"), (FR, "utf-16-be"), ("plain words", "ascii"), (FR, "utf-16"), (JA, "utf-32")],
)
def test_told_apart(text, name):
    for times in (1, 3):
        data = (text + "\n") * times
        found = charset.detect(data.encode(name))
        assert found == name or name == "utf-16" and found == "utf-16-le" or name == "utf-32" and found == "utf-32-le", (found, name)
        assert charset.decode(data.encode(name))[0] == data


def test_declared_wins_where_it_is_valid():
    assert charset.detect(b'<meta charset="windows-1251"><p>\xe9') == "cp1251"
    assert charset.detect(b'<?xml version="1.0" encoding="iso-8859-2"?><p>\xe9') == "iso8859-2"
    assert charset.detect("<meta charset=iso-8859-1>é".encode()) == "utf-8"
    assert charset.detect(b'<meta charset="shift_jis">caf\xe9 na\xefve et \xe0 c\xf4t\xe9 \xff') == "cp1252"
    assert charset.detect(b"<meta charset=nonsense>\xe9t\xe9") == "cp1252"


def test_odd_bytes():
    assert charset.decode(b"") == ("", "ascii") and charset.decode(b"a") == ("a", "ascii")
    assert charset.decode("é".encode()[:1])[0]
    assert charset.decode(bytes(range(256)))[1]
    long = ("été " * 100_000).encode("cp1252")
    assert charset.decode(long) == ("été " * 100_000, "cp1252")


def test_documents(spark):
    rows = queries_more.charset_documents(spark, "/root/testdata/sf0.01")
    by = {r.written: (r.n, r.good) for r in rows.groupBy("written").agg(F.count("*").alias("n"), F.count_if("same").alias("good")).collect()}
    assert len(by) == 5 and sum(n for n, _ in by.values()) == 1000
    assert all(good / n >= 0.98 for n, good in by.values()), by


def test_nulls(spark):
    rows = charset.decoded(spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "k long, content binary"), "k")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, None, None), (2, "x", "ascii")]
