"""Problem 5: records of evaluation splits that touch or repeat a training record, and their counts by split and source.

Records are canonicalised and hashed, and the hashes of evaluation and training records are joined. Hand-typed names and
splits are compared after folding case, punctuation and white space, names by their hashes; profiles are brought to mean 0 and
length 1 and hashed by the sides of random planes they lie on, evaluation profiles also by the sides with one of their FLIPS
least certain bits turned. The planes of a hash (``bits_for``) grow with the number of training profiles, so that by chance an
evaluation profile meets as many of them at any size, and the number of hashes (``tables_for``) grows with the planes, so that
a pair at the least correlation is found with the same probability. Every pair that shares a hash is then checked exactly.
Equal profiles take part once and are given back their records at the end. Null, short, blank (all equal) profiles and records
without a split match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import cut

from .fields import fraction, image_number, record_key, site_codes, split_name
from .plans import spread

FLIPS, SEED, PLACES = 8, 5, 64
#: Share of the pairs at the least correlation that may share no hash.
MISSED = 5e-4


def bits_for(profiles: int) -> int:
    """Planes of a hash: two to their power is at least 128 times the training profiles."""
    return min(60, max(16, math.ceil(math.log2(max(1, profiles))) + 7))


def tables_for(bits: int, least: float, pairs: int = 4000) -> int:
    """Hashes a profile needs, by trial on made pairs at the least correlation."""
    r = np.random.default_rng(SEED)
    a, b = r.standard_normal((pairs, bits)), r.standard_normal((pairs, bits))
    b = least * a + math.sqrt(1 - least * least) * b  # sides of planes are normal and correlate as the profiles do
    turned = (a > 0) != (b > 0)
    rank = np.argsort(np.argsort(np.abs(b), axis=1), axis=1)
    share = ((turned.sum(axis=1) == 0) | (turned.sum(axis=1) == 1) & (turned & (rank < FLIPS)).any(axis=1)).mean()
    return math.ceil(math.log(MISSED) / math.log1p(-share))


def splits_of(design: DataFrame) -> DataFrame:
    """(site, split): one row a record and split, for records of a known split."""
    s = design.select(F.col("crop").alias("site"), split_name(F.col("split")).alias("split"))
    return s.where("site IS NOT NULL AND split IS NOT NULL").distinct()


def touching(strips: DataFrame, least: float) -> DataFrame:
    """(left, right) stated by any row, where the left one has a seam correlation of at least ``least``; only site names count."""
    right = strips.select(F.col("site").alias("left"), F.explode(site_codes(F.col("right_neighbour"))).alias("right"))
    left = strips.select(F.explode(site_codes(F.col("left_neighbour"))).alias("left"), F.col("site").alias("right"))
    firm = strips.where(fraction(F.col("seam_corr_to_right")) >= least).select(F.col("site").alias("left")).distinct()
    return right.unionByName(left).distinct().join(firm, "left", "left_semi")


def across(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Of pairs (left, right), those of a training and an evaluation record, as (site_a, site_b), site_a < site_b."""
    mark = lambda c: F.xxhash64(c)
    a = splits.select(F.col("site").alias("_l"), F.col("split").alias("s"), mark("site").alias("_a"))
    b = splits.select(F.col("site").alias("_r"), F.col("split").alias("t"), mark("site").alias("_b"))
    both = pairs.where("left <> right").withColumns({"_a": mark("left"), "_b": mark("right")}).join(a, "_a").where("left = _l").join(b, "_b").where("right = _r").where((F.col("s") == "train") != (F.col("t") == "train"))
    return both.select(F.least("left", "right").alias("site_a"), F.greatest("left", "right").alias("site_b")).distinct()


def _unit(profiles: pd.Series) -> np.ndarray:
    p = np.stack([np.asarray(x, dtype=np.float64) for x in profiles])
    p = p - p.mean(axis=1, keepdims=True)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _hashed(profiles: DataFrame, flips: int, bits: int, tables: int) -> DataFrame:
    """(profile_id, band, mark) for each table's planes; with ``flips`` also the neighbours across the closest planes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(SEED).standard_normal((PLACES, tables * bits))
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            side = (_unit(b["profile"]) @ planes).reshape(len(b), tables, bits)
            mark = ((side > 0) * power).sum(axis=2)
            marks = [mark]
            order = np.argsort(np.abs(side), axis=2)[:, :, :flips]
            marks += [mark ^ power[order[:, :, f]] for f in range(flips)]
            m = np.stack(marks, axis=2)
            n = m.shape[2]
            yield pd.DataFrame({"profile_id": np.repeat(b["profile_id"].to_numpy(), tables * n), "band": np.tile(np.repeat(np.arange(tables), n), len(b)), "mark": m.ravel()})

    return spread(profiles).mapInPandas(make, "profile_id bigint, band int, mark bigint")


def similar_profiles(records: DataFrame, least: float) -> DataFrame:
    """records (site, profile, train BOOLEAN) -> (left, right): training and evaluation records whose profiles correlate."""
    sound = records.where((F.size("profile") == PLACES) & ~F.exists("profile", lambda v: v.isNull()) & (F.array_min("profile") < F.array_max("profile")))
    sound = sound.withColumn("profile_id", F.xxhash64("profile"))
    classes = cut(sound.groupBy("profile_id", "train").agg(F.first("profile").alias("profile")))
    train, held = classes.where("train"), classes.where("NOT train")
    bits = bits_for(train.count())
    tables = tables_for(bits, least)
    t = _hashed(train.select("profile_id", "profile"), 0, bits, tables).withColumnRenamed("profile_id", "t")
    e = _hashed(held.select("profile_id", "profile"), FLIPS, bits, tables).withColumnRenamed("profile_id", "e")
    near = t.join(e, ["band", "mark"]).select("t", "e").distinct()

    @F.pandas_udf("double")
    def pearson(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", _unit(a), _unit(b)) if len(a) else np.empty(0))

    near = near.join(train.select(F.col("profile_id").alias("t"), F.col("profile").alias("p")), "t").join(held.select(F.col("profile_id").alias("e"), F.col("profile").alias("q")), "e")
    near = near.where(pearson("p", "q") >= least - 1e-12).select("t", "e")
    a = sound.where("train").select(F.col("profile_id").alias("t"), F.col("site").alias("left")).distinct()
    b = sound.where("NOT train").select(F.col("profile_id").alias("e"), F.col("site").alias("right")).distinct()
    return near.join(a, "t").join(b, "e").select("left", "right")


def overlaps(strips: DataFrame, design: DataFrame, least_seam: float = 0.8, least_profile: float = 0.95) -> DataFrame:
    """(site_a, site_b), site_a < site_b: a training and an evaluation crop that touch or have nearly the same profile."""
    splits = splits_of(design)
    records = strips.select("site", "profile").join(splits, "site").select("site", "profile", (F.col("split") == "train").alias("train"))
    return across(touching(strips, least_seam).unionByName(similar_profiles(records, least_profile)), splits)


def overlaps_by_source(strips: DataFrame, design: DataFrame) -> DataFrame:
    """(split, image, n_pairs, n_crops): overlaps of the evaluation crops by their split and source image (-1: none given)."""
    pairs = overlaps(strips, design)
    crop = pairs.select(F.explode(F.array("site_a", "site_b")).alias("crop"), F.struct("site_a", "site_b").alias("pair"))
    named = design.select("crop", split_name(F.col("split")).alias("split"), F.coalesce(image_number(F.col("groups")), F.lit(-1)).cast("bigint").alias("image")).where("split <> 'train'").distinct()
    return crop.join(named, "crop").groupBy("split", "image").agg(F.countDistinct("pair").alias("n_pairs"), F.countDistinct("crop").alias("n_crops"))


def same_records(rows: DataFrame, key: str, split: str, text: str, source: str) -> DataFrame:
    """(split, source, n): evaluation rows whose text is that of a training row after folding case, punctuation and blanks.

    Texts without letters or digits match nothing. Training hashes are made distinct before the join, so copies cost nothing.
    """
    marked = rows.select(key, split_name(F.col(split)).alias("_s"), F.col(source).alias("_source"), record_key(F.col(text)).alias("_t")).where("_s IS NOT NULL AND _t <> ''")
    marked = marked.withColumn("_m", F.sha2("_t", 256))
    train = marked.where("_s = 'train'").select("_m").distinct()
    return marked.where("_s <> 'train'").join(train, "_m", "left_semi").groupBy(F.col("_s").alias("split"), F.col("_source").alias("source")).agg(F.countDistinct(key).alias("n"))


def same_profiles(strips: DataFrame, design: DataFrame) -> DataFrame:
    """(split, source, n): ``same_records`` over the grey profiles as canonical texts; source is the image (-1: none given).
    Null, short and blank profiles match nothing."""
    sound = strips.where((F.size("profile") == PLACES) & ~F.exists("profile", lambda v: v.isNull()) & (F.array_min("profile") < F.array_max("profile")))
    texts = sound.select("site", F.array_join(F.transform("profile", lambda v: v.cast("string")), " ").alias("text"))
    named = design.select(F.col("crop").alias("site"), "split", F.coalesce(image_number(F.col("groups")), F.lit(-1)).cast("bigint").alias("source")).where("site IS NOT NULL").distinct()
    return same_records(texts.join(named, "site"), "site", "split", "text", "source")
