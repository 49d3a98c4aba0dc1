"""Graph operators: components over shared ids, and identity resolution with constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.io import shared_folder


def _by_shuffle(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: never broadcast. Sizes are guessed from the files that a table was
    made of, also through a checkpoint, and what is exploded from a small file is much larger than that."""
    return df.hint("merge")


def connected_components(edges: DataFrame, checkpoint: bool = True) -> DataFrame:
    """``node, component`` (the smallest node) for an edge table ``a, b``.

    Labels fall to the smallest of a node's neighbours and then to their label's label; rounds grow with the
    logarithm of the diameter. Lineage is cut by ``checkpoint()`` in the folder of ``spark.checkpoint.dir``.
    """
    spark = edges.sparkSession
    if checkpoint and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    cut = (lambda df: df.checkpoint()) if checkpoint else (lambda df: df.persist())
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(_by_shuffle(labels.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        lower = labels.join(_by_shuffle(near), "node").select("node", "component", F.least("component", "seen").alias("next"))
        parent = lower.select(F.col("node").alias("next"), F.col("next").alias("above"))
        new = cut(lower.join(_by_shuffle(parent), "next").select("node", "component", F.least("next", "above").alias("new")))
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels


def shared_id_components(df: DataFrame, row_id: str, id_columns: dict[str, str]) -> DataFrame:
    """Rows that share a namespaced id belong together: ``row_id, component`` with the smallest row id.

    Rows are linked to each id's first row, so an id with many rows adds as many edges, not pairs.
    """
    ids = F.explode(F.array(*[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{space}:"), F.col(c).cast("string"))) for c, space in id_columns.items()])).alias("id")
    pairs = df.select(row_id, ids).where("id is not null")
    hub = pairs.groupBy("id").agg(F.min(row_id).alias("a"))
    edges = pairs.join(_by_shuffle(hub), "id").where(F.col(row_id) != F.col("a")).select("a", F.col(row_id).alias("b")).distinct()
    found = connected_components(edges)
    return df.select(row_id).join(_by_shuffle(found.withColumnRenamed("node", row_id)), row_id, "left").withColumn("component", F.coalesce("component", F.col(row_id)))


def assign_identities(df: DataFrame) -> DataFrame:
    """G02, first step: identity_id and identity_type from ORCID, else native id, else name key."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    ident = F.when(has("orcid"), F.concat(F.lit("orcid:"), F.col("orcid"))).when(has("native_id"), F.concat(F.lit("native:"), F.col("native_id"))).when(has("name_key"), F.concat(F.lit("name:"), F.regexp_replace("name_key", " ", "_")))
    kind = F.when(has("orcid"), "orcid").when(has("native_id"), "native_id").when(has("name_key"), "name_only")
    return df.withColumns({"identity_id": ident, "identity_type": kind})


#: Places of ids in groups that one task works on at most, where rounds can bring a component so far.
MOST_LINKS = 250_000


def resolve_identities(df: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """Unite identities that share a paper and a name key, when one given name and at most one ORCID speak for it.

    ``df`` has row_id, paper_key, name_key, given_key, identity_id, identity_type. Groups with no given name, several,
    or several ORCIDs are left alone. Rows known by name only take their group's identity one by one. Unions are made
    in the order of papers and names, so two ORCIDs never meet in a chain. Components of candidate links stream through
    tasks in that order; where one has more than ``most_links`` places, ``_contract`` first makes those unions that
    don't depend on the order of others.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    groups = (
        df.where("paper_key is not null and name_key is not null")
        .groupBy("paper_key", "name_key")
        .agg(F.collect_set(F.when(F.col("identity_type") != "name_only", F.col("identity_id"))).alias("strong"), F.min("identity_id").alias("a"), F.max("identity_id").alias("b"), F.min("given_key").alias("c"), F.max("given_key").alias("d"))
        .where("a < b and c = d and size(strong) >= 1")  # two identities, one given name
        .select("paper_key", "name_key", F.array_sort("strong").alias("strong"))
        .checkpoint()
    )
    links = _open(groups.withColumnRenamed("strong", "ids")).checkpoint()
    sizes = df.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n")).join(_by_shuffle(links.select(F.explode("ids").alias("identity_id")).distinct()), "identity_id", "left_semi").checkpoint()
    places = lambda x: x.agg(F.sum(F.size("ids"))).first()[0] or 0
    n, labels, components = places(links), None, None
    if n > most_links:
        components = connected_components(_hashed(_star(links)))
        if _largest(links, components) > most_links:
            components, before = None, n + 1
            while n > most_links and n < before:
                links, labels = _contract(links, labels, sizes)
                n, before = places(links), n - n // 10
            if n > most_links:
                components = connected_components(_hashed(_star(links)))
    people = _settle(links, components, sizes)
    if labels is not None:
        people = labels.join(_by_shuffle(people.withColumnRenamed("identity_id", "root")), "root", "full").select(F.coalesce("identity_id", "root").alias("identity_id"), F.coalesce("person", "root").alias("person"))
    people = people.checkpoint()
    members = groups.select("paper_key", "name_key", F.explode("strong").alias("identity_id")).join(_by_shuffle(people), "identity_id", "left")
    one = members.groupBy("paper_key", "name_key").agg(F.min(F.coalesce("person", "identity_id")).alias("anchor"), F.max(F.coalesce("person", "identity_id")).alias("other"))
    anchor = one.where("anchor = other").drop("other")
    apart = F.when(F.col("identity_type") == "name_only", F.xxhash64("row_id")).otherwise(0)  # rows known by name need no person; many share a name
    out = df.withColumn("__apart", apart).join(_by_shuffle(people.withColumn("__apart", F.lit(0).cast("bigint"))), ["identity_id", "__apart"], "left").drop("__apart")
    out = out.join(_by_shuffle(anchor), ["paper_key", "name_key"], "left")
    final = F.when(F.col("identity_type") == "name_only", F.coalesce("anchor", "identity_id")).otherwise(F.coalesce("person", "identity_id"))
    return out.withColumn("identity_id", final).drop("person", "anchor").withColumn("identity_type", F.when(F.col("identity_id").startswith("orcid:"), "orcid").when(F.col("identity_id").startswith("native:"), "native_id").otherwise("name_only"))


def _open(links: DataFrame) -> DataFrame:
    """Groups that may still unite something: two different ORCIDs are never united, so a group of two is refused whenever its turn comes."""
    return links.where((F.size("ids") >= 2) & (F.size(F.filter("ids", lambda x: x.startswith("orcid:"))) <= 1))


def _star(links: DataFrame) -> DataFrame:
    return links.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")


def _hashed(edges: DataFrame) -> DataFrame:
    """Names by hashes: where two are equal, two components go to the same task, one after the other, to the same result."""
    return edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))


def _largest(links: DataFrame, components: DataFrame) -> int:
    of = links.select(F.xxhash64(F.array_min("ids")).alias("node"), F.size("ids").alias("n")).join(_by_shuffle(components), "node")
    return of.groupBy("component").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0


def _strength(identity: Column, n: Column) -> Column:
    """The least is the strongest: an ORCID, then the identity of most rows, then the first by name."""
    return F.struct((~identity.startswith("orcid:")).alias("native"), (-n).alias("n"), identity.alias("root"))


def _contract(links: DataFrame, labels: DataFrame | None, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round: unions that are made whatever other groups do, then the groups left, by roots, and ``identity_id, root``.

    A group is ready for an identity without ORCID if it is the first of that identity's groups: until its turn nothing
    happens to that identity. A group that is so for all of its identities but one holds at most one ORCID when its turn comes,
    so it is accepted now. The first group of all always is; of pairs, each identity without ORCID has one, so that their
    number at least halves. An identity gets an ORCID by the first of its groups only, so groups left come after all
    unions that lead from them to an ORCID, and those that hold two by now are refused.
    """
    members = links.select("paper_key", "name_key", F.explode("ids").alias("id"))
    first = members.where(~F.col("id").startswith("orcid:")).groupBy("id").agg(F.min(F.struct("paper_key", "name_key")).alias("first"))
    seen = members.join(_by_shuffle(first), "id", "left").groupBy("paper_key", "name_key").agg(F.collect_list("id").alias("ids"), F.count_if(F.coalesce(F.col("first") != F.struct("paper_key", "name_key"), F.lit(True))).alias("waiting"))
    united = connected_components(_star(seen.where("waiting <= 1"))).withColumnRenamed("node", "identity_id")
    sized = united.join(_by_shuffle(sizes), "identity_id")
    best = sized.groupBy("component").agg(F.min(_strength(F.col("identity_id"), F.col("n"))).alias("best"))
    step = united.join(_by_shuffle(best), "component").select(F.col("identity_id").alias("id"), F.col("best.root").alias("root")).checkpoint()
    left = members.join(_by_shuffle(step), "id", "left").groupBy("paper_key", "name_key").agg(F.collect_set(F.coalesce("root", "id")).alias("ids"))
    known = step.select(F.col("id").alias("identity_id"), "root")
    if labels is not None:
        known = labels.withColumnRenamed("root", "id").join(_by_shuffle(step), "id", "full").select(F.coalesce("identity_id", "id").alias("identity_id"), F.coalesce("root", "id").alias("root"))
    return _open(left).checkpoint(), known.checkpoint()


def _settle(links: DataFrame, components: DataFrame | None, sizes: DataFrame) -> DataFrame:
    """``identity_id, person``: components (by hash) in turn, the groups of each in order; a task keeps the identities of one component."""
    rows = links.withColumn("component", F.lit(0)) if components is None else links.withColumn("node", F.xxhash64(F.array_min("ids"))).join(_by_shuffle(components), "node").drop("node")
    rows = rows.select("component", "paper_key", "name_key", F.explode("ids").alias("identity_id")).join(_by_shuffle(sizes), "identity_id")
    rows = rows.repartition("component") if components is not None else rows.repartition(1)
    ordered = rows.sortWithinPartitions("component", "paper_key", "name_key").select("component", "paper_key", "name_key", "identity_id", "n")
    return ordered.mapInArrow(_uniter(), "identity_id string, person string")


def _uniter():
    """The function of the tasks, made here so that it travels by value and workers need not import this package for it."""

    def unite(batches):
        import pyarrow as pa

        parent: dict[str, str] = {}
        size: dict[str, int] = {}
        group: list[str] = []
        at, names, people = None, [], []

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def close():
            roots = {root(x) for x in group}
            if len(roots) > 1 and sum(r.startswith("orcid:") for r in roots) <= 1:
                best = min(roots, key=lambda x: (not x.startswith("orcid:"), -size[x], x))
                for r in roots:
                    parent[r] = best
            group.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(people, pa.string())], ["identity_id", "person"])
            names.clear()
            people.clear()
            return batch

        for batch in batches:
            for component, paper, name, identity, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (component, paper, name) != at:
                    close()
                    if at is not None and component != at[0]:
                        for x in size:
                            names.append(x)
                            people.append(root(x))
                            if len(names) >= 10_000:
                                yield out()
                        parent.clear()
                        size.clear()
                    at = (component, paper, name)
                group.append(identity)
                size[identity] = n
        close()
        for x in size:
            names.append(x)
            people.append(root(x))
            if len(names) >= 10_000:
                yield out()
        yield out()

    return unite
