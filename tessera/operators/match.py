"""Matching records across sources, first-row rules and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order. Partial aggregation keeps one row a key and task, so a
    hot key needs no task of its own."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    order_by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, order_by).alias("__row"))
    return best.select("__row.*")


def first_value(column: str, order: str) -> Column:
    """The first value of a group that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def match_two_keys(existing: DataFrame, external: DataFrame, source: str, order: str = "ord") -> DataFrame:
    """Fold an external source into the existing outcomes.

    Both sides have project_id, title and description; existing also ``ord``, ``source``, ``match_basis`` and id
    columns; external ``<source>_outcome_id`` and ``ord``. An external row matches the first existing row with its
    project and title, else with its project and description; the last such row's id is written and the source added.
    Rows that match nothing are added, once for each key, with ``ord`` after all existing ones.
    """
    id_col = f"{source}_outcome_id"

    def keyed(df: DataFrame) -> DataFrame:
        t, d = text.match_text(F.col("title")), text.match_text(F.col("description"))
        return df.withColumns({"__t": F.when(t != "", text.match_key(F.col("project_id"), t)), "__d": F.when(d != "", text.match_key(F.col("project_id"), d))})

    old, new = keyed(existing), keyed(external)
    first_of = lambda k: old.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"{k}_ord"))
    found = new.join(first_of("__t"), "__t", "left").join(first_of("__d"), "__d", "left").withColumn("__hit", F.coalesce("__t_ord", "__d_ord"))
    written = found.where("__hit is not null").groupBy(F.col("__hit").alias(order)).agg(F.max_by(id_col, order).alias("__id"))
    joined = existing.join(written, order, "left")
    listed = F.array_contains(F.split("source", "; "), source)
    updated = joined.withColumns({id_col: F.coalesce("__id", F.col(id_col) if id_col in existing.columns else F.lit(None).cast("string")), "source": F.when(F.col("__id").isNotNull() & ~listed, F.concat("source", F.lit(f"; {source}"))).otherwise(F.col("source"))}).drop("__id")
    fresh = found.where("__hit is null and (__t is not null or __d is not null)").withColumn("match_basis", F.when(F.col("__t").isNotNull(), "title").otherwise("description")).withColumn("__key", F.coalesce(F.concat(F.lit("t"), "__t"), F.concat(F.lit("d"), "__d")))
    fresh = keep_first(fresh, ["__key"], [order])
    last = existing.agg(F.coalesce(F.max(order), F.lit(0)).alias("__last"))
    fresh = fresh.join(F.broadcast(last)).withColumns({order: (F.col(order) + F.col("__last") + 1).cast("long"), "source": F.lit(source)})
    return updated.unionByName(fresh.select(*[c for c in fresh.columns if c in updated.columns]), allowMissingColumns=True)


def match_basis(title: Column, description: Column) -> Column:
    """P65"""
    return F.when(text.match_text(title) != "", "title").when(text.match_text(description) != "", "description").otherwise("other")


def without_removed(child: DataFrame, removed: DataFrame, keys: list[str], keep_kept: bool = False, kept: DataFrame | None = None) -> DataFrame:
    """Child rows whose keys are among the removed parents' go, the kept parent's own rows too, unless
    ``keep_kept`` names the parents whose rows stay."""
    gone = removed.select(*keys).distinct()
    if keep_kept and kept is not None:
        gone = gone.join(kept.select(*keys).distinct(), keys, "left_anti")
    return child.join(gone, keys, "left_anti")


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``matched``; raises where the right key repeats."""
    twice = right.groupBy(key).count().where("count > 1 and " + f"`{key}` is not null").limit(5).collect()  # at most five rows
    if twice:
        raise ValueError(f"{key} repeats on the right: {[r[key] for r in twice]}")
    return left.join(right.withColumn("__m", F.lit(True)), key, "left").withColumn("matched", F.coalesce("__m", F.lit(False))).drop("__m")


def absent_by_all(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the base has by none of the keys."""
    for k in keys:
        df = df.join(base.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return df


def first_equal(df: DataFrame, key: str, candidates: str, field: str, wanted: str) -> DataFrame:
    """The first candidate (array of structs) whose field equals the wanted value, as ``found``."""
    return df.withColumn("found", F.get(F.filter(candidates, lambda c: c[field] == F.col(wanted)), 0))


def participants(df: DataFrame, key: str, hrefs: str, lead: str, names: DataFrame) -> DataFrame:
    """Names (``href, name``) of participants other than the lead, sorted and joined by "; "."""
    each = df.select(key, lead, F.explode(hrefs).alias("href")).join(names, "href", "left")
    lead_name = df.select(key, F.col(lead).alias("href")).join(names, "href", "left").select(key, F.col("name").alias("__lead"))
    sets = each.where("name is not null").groupBy(key).agg(F.collect_set("name").alias("__names"))
    out = df.select(key).join(sets, key, "left").join(lead_name, key, "left")
    others = F.array_sort(F.array_except(F.coalesce("__names", F.array().cast("array<string>")), F.array("__lead")))
    return out.select(key, F.col("__lead").alias("lead_name"), F.array_join(others, "; ").alias("participants"))


def global_ids(outcomes: DataFrame, global_id: str, sources) -> DataFrame:
    """``source, outcome_id_norm, global id`` from one id column for each source, each pair once."""
    from tessera.functions import ids

    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), ids.native_id_key(F.col(f"{s}_outcome_id")).alias("outcome_id_norm")) for s in sources])).alias("p")
    return outcomes.select(global_id, pairs).select("p.source", "p.outcome_id_norm", global_id).where("outcome_id_norm is not null").groupBy("source", "outcome_id_norm").agg(F.min(global_id).alias(global_id))


def union_with_terms(df: DataFrame, key: str, order: str, term: str) -> DataFrame:
    """The first sighting of each key, with all terms under which it was seen, sorted and joined."""
    others = [c for c in df.columns if c not in (key, term)]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r"), F.array_join(F.array_sort(F.collect_set(term)), "; ").alias("terms")).select(key, "r.*", "terms")


def tagged_union(second: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """Rows of the second round, and those only the first has, with ``provenance``."""
    in_first = second.join(first.select(key).distinct().withColumn("__f", F.lit(True)), key, "left")
    a = in_first.withColumn("provenance", F.when(F.col("__f"), "both").otherwise("round2_only")).drop("__f")
    b = first.join(second.select(key).distinct(), key, "left_anti").withColumn("provenance", F.lit("round1_only"))
    return a.unionByName(b, allowMissingColumns=True)


def ordinal_ids(df: DataFrame, group: str, order: str, prefix: str = "OUT", width: int = 6) -> DataFrame:
    """``group, global_id``: groups numbered by their first row in order.

    Numbers come from counts of range partitions, so no task sees all groups.
    """
    firsts = df.groupBy(group).agg(F.min(order).alias("__ord"))
    return firsts.join(number_rows(firsts.select(group, "__ord"), ["__ord", group], "__n").select(group, "__n"), group).select(group, F.format_string(f"{prefix}%0{width}d", F.col("__n")).alias("global_id"))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in a total order: range partitions, numbers within them, and offsets of their sizes."""
    parted = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()).persist()
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return parted.withColumn("__in", F.row_number().over(inside)).join(F.broadcast(offset), "__part").withColumn(name, F.col("__off") + F.col("__in")).drop("__part", "__in", "__off")
