"""Style functions: sizes, colours, fonts and inline declarations as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named colours (fixed values).
COLOURS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0),
    "cyan": (0, 255, 255), "magenta": (255, 0, 255), "silver": (192, 192, 192), "gray": (128, 128, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0),
    "green": (0, 128, 0), "purple": (128, 0, 128), "teal": (0, 128, 128), "navy": (0, 0, 128),
}
#: Slots of the font features, in order (fixed values).
FONT_SIZES = ["medium", "xx-small", "x-small", "small", "large", "x-large", "xx-large", "smaller", "larger", "inherit"]
FONT_WEIGHTS = ["normal", "bold", "inherit"]
FONT_STYLES = ["normal", "italic", "oblique", "inherit"]
#: Largest pixel size of each size name (fixed values).
PIXEL_LIMITS = [(9.0, "xx-small"), (11.0, "x-small"), (14.0, "small"), (17.0, "medium"), (22.0, "large"), (30.0, "x-large")]

_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_hot(slot: Column, names: list[str], otherwise: str) -> Column:
    slots = F.array(*map(F.lit, names))
    known = F.coalesce(F.try_element_at(F.filter(slots, lambda n: n == slot), F.lit(1)), F.lit(otherwise))
    return let(known, lambda k: F.transform(slots, lambda n: F.when(n == k, 1.0).otherwise(0.0)))


def size_parts(size: Column) -> Column:
    """A struct of kind (0 a share (%), 1 pixels, 2 em or rem, 3 invalid) and val (0 where invalid)."""

    def read(x: Column) -> Column:
        number, unit = x["number"], x["unit"]
        kind = F.when(number.isNull(), 3).when(unit == "%", 0).when(unit.isin("em", "rem"), 2).when(unit.isin("px", "in", "pt", "pc", ""), 1).otherwise(3)
        value = (
            F.when(number.isNull(), 0.0)
            .when(unit == "%", number / 100)
            .when(unit.isin("em", "rem", "px", ""), number)
            .when(unit == "in", number * 96)
            .when(unit == "pt", number * 96 / 72)
            .when(unit == "pc", number * 12 * 96 / 72)
            .otherwise(0.0)
        )
        return F.named_struct(F.lit("kind"), F.coalesce(kind, F.lit(3)), F.lit("val"), F.coalesce(value, F.lit(0.0)))

    def cut(text: Column) -> Column:
        return F.named_struct(F.lit("number"), F.regexp_extract(text, _NUMBER, 1).try_cast("double"), F.lit("unit"), F.regexp_replace(text, _NUMBER, ""))

    return let(let(F.trim(size), cut), read)


def size_kind(size: Column) -> tuple[Column, Column]:
    """(kind, value) of size_parts."""
    parts = size_parts(size)
    return parts["kind"], parts["val"]


def size_features(size: Column) -> Column:
    return let(size_parts(size), lambda s: F.named_struct(F.lit("class"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(s["kind"] == k, 1.0).otherwise(0.0)), F.lit("val"), s["val"]))


def font_size_slot(size: Column) -> Column:
    def choose(s: Column) -> Column:
        kind, value = s["p"]["kind"], s["p"]["val"]
        pixels = F.lit("xx-large")
        for limit, name in reversed(PIXEL_LIMITS):
            pixels = F.when(value <= limit, name).otherwise(pixels)
        relative = F.when(value >= 1.01, "larger").when(value <= 0.99, "smaller").otherwise("inherit")
        return F.when(s["size"].isin(FONT_SIZES), s["size"]).when(kind == 3, "inherit").when(kind == 1, pixels).otherwise(relative)

    return let(let(size, lambda x: F.named_struct(F.lit("size"), x, F.lit("p"), size_parts(x))), choose)


def font_size(size: Column) -> Column:
    return one_hot(font_size_slot(size), FONT_SIZES, "inherit")


def font_weight(weight: Column) -> Column:
    slot = F.when(weight.isin("100", "200", "300", "400", "500", "lighter", "initial"), "normal").when(weight.isin("600", "700", "800", "900", "bolder"), "bold").otherwise(weight)
    return one_hot(F.coalesce(slot, F.lit("inherit")), FONT_WEIGHTS, "inherit")


def font_style(style: Column) -> Column:
    return one_hot(F.coalesce(F.when(style == "initial", "normal").otherwise(style), F.lit("inherit")), FONT_STYLES, "inherit")


def style_map(style: Column) -> Column:
    """Declarations of an inline style by lower-case property; the last of equal ones holds."""
    parts = F.filter(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.instr(d, ":") > 0)
    pairs = F.transform(parts, lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("key"), F.trim(F.regexp_replace(d, r"^[^:]*:", "")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def style_value(style: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(style, F.lit(name)), F.lit(""))


def _channels(text: Column) -> Column:
    return F.split(F.regexp_extract(text, r"\((.*)\)", 1), ", ")


def _hsl(parts: Column) -> Column:
    """Rounded RGB of hue, saturation % and lightness %; null where one is missing or out of range."""
    h = F.try_element_at(parts, F.lit(1)).try_cast("int")
    s = F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"^([0-9.]+)%$", 1).try_cast("double") / 100
    light = F.regexp_extract(F.try_element_at(parts, F.lit(3)), r"^([0-9.]+)%$", 1).try_cast("double") / 100
    c = (1 - F.abs(2 * light - 1)) * s
    x = c * (1 - F.abs(F.pmod(h / 60, F.lit(2.0)) - 1))
    m = light - c / 2
    sector = F.floor(h / 60)
    pick = lambda order: F.coalesce(*[F.when(sector == k, v) for k, v in enumerate(order)])
    zero = F.lit(0.0)
    rgb = F.array(pick([c, x, zero, zero, x, c]), pick([x, c, c, x, zero, zero]), pick([zero, zero, x, c, c, x]))
    return F.when((h >= 0) & (h < 360) & (s <= 1) & (light <= 1), F.transform(rgb, lambda v: F.bround((v + m) * 255)))


def colour(text: Column) -> Column:
    """[r, g, b, alpha] of a CSS colour, channels over 255; alpha 0 where none is given, all 0 where it is
    malformed, black for an unknown name."""
    parts = _channels(text)
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    scaled = lambda a: F.transform(a, lambda v: v / 255)
    bad = F.array(*[F.lit(0.0)] * 4)
    whole = lambda a, n: (F.size(a) == n) & F.forall(a, lambda v: v.isNotNull())
    hexed = F.array(*[F.conv(F.substring(text, k, 2), 16, 10).try_cast("double") for k in (2, 4, 6)])
    hsl = _hsl(parts)
    named = bad
    for name, rgb in COLOURS.items():
        named = F.when(F.lower(text) == name, F.array(*[F.lit(v / 255) for v in rgb], F.lit(0.0))).otherwise(named)
    return F.coalesce(
        F.when(text.startswith("rgba"), F.when(whole(numbers, 4), F.concat(scaled(F.slice(numbers, 1, 3)), F.slice(numbers, 4, 1))).otherwise(bad))
        .when(text.startswith("rgb"), F.when(whole(numbers, 3), F.concat(scaled(numbers), F.array(F.lit(0.0)))).otherwise(bad))
        .when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.concat(scaled(hexed), F.array(F.lit(0.0))))
        .when(text.startswith("hsla"), F.when((F.size(parts) == 4) & hsl.isNotNull(), F.concat(scaled(hsl), F.array(F.coalesce(F.try_element_at(numbers, F.lit(4)), F.lit(0.0))))).otherwise(bad))
        .when(text.startswith("hsl"), F.when((F.size(parts) == 3) & hsl.isNotNull(), F.concat(scaled(hsl), F.array(F.lit(0.0)))).otherwise(bad))
        .otherwise(named),
        bad,
    )


def shorthand_font(font: Column) -> tuple[Column, Column, Column]:
    """(style, weight, size) of a font shorthand; empty where it does not say."""
    words = F.split(F.lower(F.trim(font)), r"\s+")
    style = F.coalesce(F.try_element_at(F.filter(words, lambda w: w.isin("italic", "oblique")), F.lit(1)), F.lit(""))
    weight = F.coalesce(F.try_element_at(F.filter(words, lambda w: w.isin("bold", "bolder", "lighter") | w.rlike(r"^[1-9]00$")), F.lit(1)), F.lit(""))
    size = F.coalesce(F.try_element_at(F.filter(words, lambda w: w.rlike(r"^(\d|\.\d)") & ~w.rlike(r"^[1-9]00$") | w.isin(FONT_SIZES[:-1])), F.lit(1)), F.lit(""))
    return style, weight, F.substring_index(size, "/", 1)


def simple_font(tag: Column, attrs: Column, style: Column) -> tuple[Column, Column, Column]:
    """(size, weight, style) of an element from its inline style, else from its tag and attributes."""
    short_style, short_weight, short_size = shorthand_font(style_value(style, "font"))
    first = lambda a, b: F.when(style_value(style, a) != "", style_value(style, a)).otherwise(b)
    none = F.size(style) == 0
    given = F.coalesce(F.try_element_at(attrs, F.lit("size")), F.lit(""))
    step = given.try_cast("int")
    by_step = F.when(given.rlike(r"^\+"), "larger").when(given.rlike("^-"), "smaller")
    for k, name in enumerate(["x-small", "small", "medium", "large", "x-large", "xx-large", "xx-large"], 1):
        by_step = by_step.when(step == k, name)
    size = F.when(none & (tag == "font"), F.coalesce(by_step.otherwise("inherit"), F.lit("inherit"))).when(none, "inherit").otherwise(first("font-size", short_size))
    weight = F.when(none & tag.isin("b", "strong"), "bold").when(none, "inherit").otherwise(first("font-weight", short_weight))
    slant = F.when(none & tag.isin("i", "em"), "italic").when(none, "inherit").otherwise(first("font-style", short_style))
    return size, weight, slant
