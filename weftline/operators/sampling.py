"""Splits, folds, batches, shuffles and samples; every order is total and hashed, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import rank_rows


def hash_order(key: str, seed: int) -> Column:
    """The order that stands for a shuffle with a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_int(key: Column, seed: int) -> Column:
    """32 bits of md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash_share(key: Column, seed: int) -> Column:
    """A share in [0, 1) of each key."""
    return hash_int(key, seed) / F.lit(4294967296.0)


def shuffle(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    return rank_rows(df, [hash_order(key, seed), F.col(key)], name)


def kfold(df: DataFrame, key: str, label: str, folds: int, seed: int = 0, start: int = 0) -> DataFrame:
    """Folds dealt in turn over the classes, shuffled within each; the turn runs on from class to class."""
    ranked = rank_rows(df, [F.col(label), hash_order(key, seed), F.col(key)], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") + start, F.lit(folds)).cast("int")).drop("_rank")


def rank_in_class(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Hashed place (from 0) of each row in its class, and the class's size; classes may be few and large."""
    ranked = rank_rows(df, [F.col(label), hash_order(key, seed), F.col(key)], "_rank")
    classes = ranked.groupBy(F.col(label).alias("_label")).agg(F.min("_rank").alias("_first"), F.count("*").alias("class_size"))
    return ranked.join(classes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_label")


def stratified_split(df: DataFrame, key: str, label: str, valid_share: float, seed: int = 0) -> DataFrame:
    """Per class the first max(floor(n * share), 1) rows in hashed order are 'valid', if the share is over 0."""
    n_valid = F.greatest(F.floor(F.col("class_size") * valid_share), F.lit(1)) if valid_share > 0 else F.lit(0)
    return rank_in_class(df, key, label, seed).withColumn("split", F.when(F.col("place") < n_valid, "valid").otherwise("train")).drop("place", "class_size")


def head_split(df: DataFrame, order: str, valid_share: float) -> DataFrame:
    """The first floor(n * share) rows are 'valid'."""
    total = df.agg(F.floor(F.count("*") * valid_share).alias("_valid"))
    ranked = rank_rows(df, [F.col(order)], "_rank").join(F.broadcast(total))
    return ranked.withColumn("split", F.when(F.col("_rank") < F.col("_valid"), "valid").otherwise("train")).drop("_rank", "_valid")


def directory_split(df: DataFrame, directory: str, valid_share: float) -> DataFrame:
    """The first floor(#directories * share) directories are 'valid' with all their rows."""
    split = head_split(df.select(directory).distinct(), directory, valid_share)
    return df.join(split, directory)


def batches(df: DataFrame, order: list[Column], size: int, drop_remainder: bool = False) -> DataFrame:
    """batch and place in it; with drop_remainder rows of an incomplete last batch go."""
    ranked = rank_rows(df, order, "_rank")
    out = ranked.withColumn("batch", F.floor(F.col("_rank") / size).cast("long")).withColumn("place", (F.col("_rank") % size).cast("long"))
    if drop_remainder:
        whole = df.agg(F.floor(F.count("*") / size).alias("_whole"))
        out = out.join(F.broadcast(whole)).where(F.col("batch") < F.col("_whole")).drop("_whole")
    return out.drop("_rank")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with `epoch`."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def concatenate(parts: list[DataFrame | None]) -> DataFrame | None:
    """UNION ALL of those that are there."""
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resample(df: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """`draws` hashed draws with replacement from rows ranked by key."""
    ranked = rank_rows(df, [F.col(key)], "_rank")
    total = ranked.agg(F.count("*").alias("_n"))
    drawn = df.sparkSession.range(draws).join(F.broadcast(total)).select(F.col("id").alias("draw"), (hash_int(F.col("id"), seed) % F.col("_n")).alias("_rank"))
    return drawn.join(ranked, "_rank").drop("_rank")


def round_robin(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    return rank_rows(df, order, "_rank").withColumn("shard", (F.col("_rank") % shards).cast("int")).drop("_rank")


def bigrams(df: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """Label pairs of neighbours as label * 10 + next label; the last of a group has none."""
    following = F.lead(label).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_next", following).where("_next is not null").withColumn("edge_label", F.col(label) * 10 + F.col("_next")).drop("_next")


def runs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Numbers (from 0) of runs of equal values within a group's order."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    start = F.when(F.row_number().over(w) == 1, 0).otherwise(new)
    return df.withColumn("_new", start).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def patches(values: Column, key: Column, size: int, seed: int = 0) -> Column:
    """A hashed window of `size` neighbours of an array longer than size + 1, else null."""
    n = F.size(values)
    start = hash_int(key, seed) % F.greatest(n - size + 1, F.lit(1))
    return F.when(n > size + 1, F.slice(values, (start + 1).cast("int"), F.lit(size)))


def positions(place: Column, dim: int) -> Column:
    """Sinusoidal encoding of a place: sines, then cosines, of dim / 2 rising wavelengths."""
    half = dim // 2
    angle = lambda i: place.cast("double") / F.pow(F.lit(10000.0), i.cast("double") / half)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def cap_per_group(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most `most` rows a group: the sampling cap of subgraphs per page."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def zip_pairs(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Pairs of a group's members: its odd and even members in order, place by place; what is left of the
    longer list meets a hashed member of the shorter. A group of one has no pair."""
    w = Window.partitionBy(group).orderBy(key)
    ranked = df.select(group, key, (F.row_number().over(w) - 1).alias("r"))
    left = ranked.where("r % 2 = 0").select(group, F.col(key).alias("left_id"), F.floor(F.col("r") / 2).alias("place"))
    right = ranked.where("r % 2 = 1").select(F.col(group).alias("_group"), F.col(key).alias("right_id"), F.floor(F.col("r") / 2).alias("_place"))
    n_right = right.groupBy("_group").agg(F.count("*").alias("_n"))
    wanted = left.join(n_right, F.col(group) == F.col("_group")).drop("_group")
    at = F.when(F.col("place") < F.col("_n"), F.col("place")).otherwise(hash_int(F.col("left_id"), seed) % F.col("_n"))
    return wanted.withColumn("_at", at).join(right, (F.col(group) == F.col("_group")) & (F.col("_at") == F.col("_place"))).select(group, "left_id", "right_id")


def permute_side(place: Column, size: Column, share: float) -> Column:
    """The place whose second side a pair takes: the first floor(size * share) places are reversed."""
    p = F.floor(size * share)
    return F.when(place < p, p - 1 - place).otherwise(place)
