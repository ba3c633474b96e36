"""Which record each unit of text is: overrides, one work to a source, titles one to one, ordinals, document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import align

#: Scores from which a title match stands by itself (fixed value).
SURE = 0.6


def primaries(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """The first record of each work of a source, with the others as its aliases; records that overrides give away are none."""
    cand = records.filter(~F.col("collection"))
    works = cand.groupBy("source", "work_id").agg(F.min(F.struct("ord", "record_id")).alias("first"), F.sort_array(F.collect_list("record_id")).alias("all"))
    first = works.select(F.col("first.record_id").alias("record_id"), F.filter("all", lambda x: x != F.col("first.record_id")).alias("aliases"))
    return cand.join(first, "record_id").join(overrides.filter("record_id IS NOT NULL").select("record_id").distinct(), "record_id", "left_anti").select("source", "record_id", "ord", "tokens", "numbers", "aliases")


def identify(units: DataFrame, records: DataFrame, overrides: DataFrame, apart: tuple[str, ...]) -> DataFrame:
    """unit_id, record_id, method, identity, inclusion, aliases of every unit.

    ``units``: unit_id, source, ord, div_type, chars, frames, tokens, numbers; ``records``: record_id, source, work_id,
    ord, collection, tokens, numbers; ``overrides``: unit_id (one row a unit), record_id or null, identity, inclusion.
    ``apart`` are types of divisions that are no works.  Units of a source are assigned together.
    """
    prim = primaries(records, overrides)
    known = records.filter(~F.col("collection")).groupBy("source").agg(F.lit(True).alias("known"))
    n_prim = prim.groupBy("source").agg(F.count("*").alias("n_prim"))
    o = overrides.select("unit_id", F.col("record_id").alias("o_record"), F.col("identity").alias("o_identity"), F.col("inclusion").alias("o_inclusion"), F.lit(True).alias("forced"))
    kind = F.coalesce(F.col("div_type").isin(*apart), F.lit(False))
    u = units.join(o, "unit_id", "left").join(known, "source", "left").join(n_prim, "source", "left").withColumn("n_prim", F.coalesce("n_prim", F.lit(0)))
    u = u.withColumn("apart", kind).withColumn("open", F.col("forced").isNull() & F.col("known").isNotNull() & ~kind & (F.coalesce("chars", F.lit(0)) > 0))
    u = u.join(u.filter("open").groupBy("source").agg(F.count("*").alias("n_open")), "source", "left")

    only = prim.join(n_prim.filter("n_prim = 1"), "source").select("source", F.col("record_id").alias("only_record"), F.col("aliases").alias("only_aliases"))
    several = n_prim.filter("n_prim > 1").select("source")
    made = align.assign(u.filter("open").join(several, "source", "left_semi").select("source", F.col("ord").alias("id"), "tokens", "numbers"), prim.join(several, "source", "left_semi").select("source", F.col("ord").alias("id"), "tokens", "numbers"), "source")
    made = made.select("source", F.col("unit").alias("ord"), F.col("title").alias("r_ord"), "score", "how")
    numbers = units.select("source", "ord", F.col("numbers").alias("given"))
    named = prim.filter(F.size("numbers") > 0).select("source", F.col("ord").alias("p_ord"), F.col("numbers").alias("named"))
    fits = F.size(F.array_except("named", "given")) == 0
    ordinal = made.join(numbers, ["source", "ord"]).filter(F.size("given") > 0).join(named, "source").filter(fits).groupBy("source", "ord").agg(F.count("*").alias("n_fit"), F.max("p_ord").alias("fit"))
    made = made.join(ordinal, ["source", "ord"], "left").withColumn("unique", F.coalesce((F.col("n_fit") == 1) & (F.col("fit") == F.col("r_ord")), F.lit(False)))
    made = made.join(prim.select("source", F.col("ord").alias("r_ord"), F.col("record_id").alias("t_record"), F.col("aliases").alias("t_aliases")), ["source", "r_ord"]).select("source", "ord", "t_record", "t_aliases", "score", "how", "unique")

    u = u.join(only, "source", "left").join(made, ["source", "ord"], "left")
    titled = F.col("how").isNotNull() & (F.col("how") != "tie")
    method = (
        F.when(F.col("forced"), "manual").when(F.col("known").isNull(), "no record").when(F.col("apart"), F.when(F.col("frames"), "frames in a division apart").otherwise("division apart")).when(~F.col("open"), "no text")
        .when(F.col("n_prim") == 1, F.when(F.col("n_open") == 1, "one to one").otherwise("one work"))
        .when(F.col("how") == "tie", "tie").when(F.col("how") == "order", F.when(F.col("unique"), "order and ordinal").otherwise("order"))
        .when(titled, F.when(F.col("score") >= SURE, "title").when(F.col("unique"), "title and ordinal").otherwise("weak title")).otherwise("unmatched")
    )
    u = u.withColumn("method", method)
    m = F.col("method")
    single = m.isin("one to one", "one work")
    part = F.size("numbers") > 0
    sure = m.isin("one to one", "title", "title and ordinal", "order and ordinal") | ((m == "one work") & part)
    identity = F.when(F.col("forced"), F.col("o_identity")).when(sure | (m == "division apart"), "confirmed").otherwise("pending")
    inclusion = F.when(F.col("forced"), F.col("o_inclusion")).when(m == "division apart", "excluded").when(sure & (m != "one work"), "proposed").otherwise("pending")
    chosen = F.when(F.col("forced"), F.col("o_record")).when(single, F.col("only_record")).when(titled & F.col("open"), F.col("t_record"))
    aliases = F.when(single, F.col("only_aliases")).when(F.col("forced").isNull() & titled, F.col("t_aliases"))
    return u.select("unit_id", chosen.alias("record_id"), "method", identity.alias("identity"), inclusion.alias("inclusion"), F.coalesce(aliases, F.array().cast("array<long>")).alias("aliases"))
