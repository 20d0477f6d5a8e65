"""References to records that do not exist: direct orphans, and what they drag along.

A *reference* is one row (record_table, record_key, ref, period, ...). ``direct`` finds those that name nothing;
``cascade`` then follows the foreign keys backwards: whatever points at a record that holds a broken reference is an
inherited orphan, level by level, until a level adds nothing.

Defined results. Null and blank references are no references; a link of a concept without path is read from the root, one in
a null bundle leads nowhere. A null in the key of the record is kept as a null key.
Repeated rows and ties on the time of a state (identical states) count once. Empty tables give empty results. Only the
named columns are read, so further columns, whatever their names, have no effect.
"""

from itertools import count, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut

#: The address of an inline Markdown link.
LINK = r"\]\(\s*<?([^)\s>]*)"
#: A fenced block, up to its closing fence or the end of the text.
FENCE = r"(?s)(?<=^|\n)[ ]{0,3}(`{3,}|~{3,})[^\n]*(?:\n.*?(?:\n[ ]{0,3}\1[`~]*[ \t\r]*(?=\n|\z)|\z)|\z)"


def key(c: Column) -> Column:
    """The form in which names are compared: outer white space and case do not count."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def latest(states: DataFrame, by: str, at: str, *columns: str) -> DataFrame:
    """One row per ``by``: ``columns`` of its row with the greatest ``at``, in one partially aggregated shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(at, *[F.col(c).cast("string") for c in columns])).alias("state")
    return states.where(F.col(by).isNotNull()).groupBy(by).agg(best).select(by, "state.*")


def live_artifacts(artifacts: DataFrame) -> DataFrame:
    """(id, path, aliases) of every artifact whose newest state is not deleted."""
    return latest(artifacts, "id", "updated_at", "path", "aliases", "deleted_at").where("deleted_at IS NULL").drop("deleted_at")


def names_of(live: DataFrame) -> DataFrame:
    """(name, path): every name a live artifact answers to."""
    names = F.array_compact(F.concat(F.array("id", "path"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return live.select("path", F.explode(names).alias("name")).select(key(F.col("name")).alias("name"), "path").where("name <> ''")


def resolve_address(address: Column, base: Column) -> Column:
    """The path that a link address names, from the root of its bundle (leading ``/``) or the folder of ``base``; null above the root."""
    plain = F.split_part(address, F.lit("#"), F.lit(1))
    folder = F.regexp_replace(F.coalesce(base, F.lit("")), r"[^/]*$", "")
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(folder, plain))
    steps = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    walk = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.array_append(done, s)).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)),
    )
    return F.array_join(walk, "/")


def body_links(concepts: DataFrame) -> DataFrame:
    """(concept_key, bundle, path, period, ref, target) for every relative ``.md`` link outside fences."""
    text = F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), FENCE, "\n")
    links = concepts.where(F.col("body").contains("](")).select(
        "concept_key", "bundle", "path", F.col("updated_at").alias("period"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), 1))).alias("ref")
    )
    links = links.where(~F.col("ref").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & F.split_part("ref", F.lit("#"), F.lit(1)).endswith(".md"))
    return links.withColumn("target", resolve_address(F.col("ref"), F.col("path")))


def direct(artifacts: DataFrame, relationships: DataFrame, projections: DataFrame, concepts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Every broken reference: (record_table, record_key, ref, holder, period), distinct.

    ``holder`` is the record that holds it: a path of an artifact, or of a concept within its bundle. The anti-joins go by
    the name referred to; a hub there makes one skewed partition, which adaptive execution splits.
    """
    live = live_artifacts(artifacts)
    names, paths = names_of(live).select("name").distinct(), live.select("path").distinct()
    inner = relationships.where(~F.coalesce("is_external", F.lit(False)))
    target = inner.select("rel_key", F.col("target").alias("ref"), "source_path", F.col("declared_at").alias("period"), key(F.col("target")).alias("name")).where("name <> ''")
    path = inner.select("rel_key", F.col("resolved_path").alias("ref"), "source_path", F.col("declared_at").alias("period"), F.col("resolved_path").alias("path")).where("path IS NOT NULL")
    listed = projections.select("projection_key", F.explode("unresolved_refs").alias("ref"), "artifact_path", F.col("projected_at").alias("period"))
    listed = listed.withColumn("name", key(F.col("ref"))).where("name <> ''")
    links = body_links(concepts) if links is None else links

    def rows(df: DataFrame, table: str, record: str, holder: str) -> DataFrame:
        return df.select(F.lit(table).alias("record_table"), F.col(record).cast("bigint").alias("record_key"), "ref", F.col(holder).alias("holder"), "period")

    broken = rows(target.join(names, "name", "left_anti"), "relationships", "rel_key", "source_path")
    broken = broken.union(rows(path.join(paths, "path", "left_anti"), "relationships", "rel_key", "source_path"))
    broken = broken.union(rows(listed.join(names, "name", "left_anti"), "projections", "projection_key", "artifact_path"))
    there = concepts.select("bundle", F.col("path").alias("target")).distinct()
    where = F.concat_ws(":", "bundle", "path")
    broken = broken.union(rows(links.join(there, ["bundle", "target"], "left_anti").withColumn("where", where), "concepts", "concept_key", "where"))
    return broken.distinct()


def leading(artifacts: DataFrame, relationships: DataFrame, concepts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(record_table, record_key, ref, holder, period, parent): the references that do lead to a record, ``parent``."""
    names = names_of(live_artifacts(artifacts)).distinct()
    inner = relationships.where(~F.coalesce("is_external", F.lit(False)))
    inner = inner.select("rel_key", F.col("target").alias("ref"), "source_path", F.col("declared_at").alias("period"), key(F.col("target")).alias("name")).where("name <> ''").distinct()
    a = inner.join(names, "name").select(F.lit("relationships").alias("record_table"), F.col("rel_key").cast("bigint").alias("record_key"), "ref", F.col("source_path").alias("holder"), "period", F.col("path").alias("parent"))
    there = concepts.select("bundle", F.col("path").alias("target")).distinct()
    b = (body_links(concepts) if links is None else links).join(there, ["bundle", "target"], "left_semi")
    b = b.select(F.lit("concepts"), F.col("concept_key").cast("bigint"), "ref", F.concat_ws(":", "bundle", "path"), "period", F.concat_ws(":", "bundle", "target"))
    return a.union(b).where("holder <> parent").distinct()


def cascade(broken: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(holder, level): 0 for holders of a broken reference, n for those that reach one over n foreign keys at least.

    Each round is a semi-join of the edges with the last level only and an anti-join with what is known; every level is
    written to the checkpoint folder, so the plan does not grow. It ends when a round adds nothing, or at ``most`` rounds if given.
    """
    edges = cut(links.select(F.col("holder").alias("child"), "parent").distinct())
    known = level = cut(broken.select("holder").where("holder IS NOT NULL").distinct().withColumn("level", F.lit(0)))
    for n in takewhile(lambda n: most is None or n <= most, count(1)):
        reached = edges.join(level.select(F.col("holder").alias("parent")), "parent", "left_semi").select(F.col("child").alias("holder")).distinct()
        level = cut(reached.join(known, "holder", "left_anti").withColumn("level", F.lit(n)))
        if level.isEmpty():
            break
        known = known.union(level)
        if n % 50 == 0:
            known = cut(known)
    return known


def orphans(artifacts: DataFrame, relationships: DataFrame, projections: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, holders). References: (record_table, record_key, ref, holder, period, level), level 0 for those that name
    nothing and n for those that lead to a record of level n - 1; holders: (holder, level)."""
    bodies = cut(body_links(concepts))  # the texts are taken apart once
    broken = cut(direct(artifacts, relationships, projections, concepts, bodies))
    links = leading(artifacts, relationships, concepts, bodies)
    holders = cascade(broken, links)
    parents = holders.select(F.col("holder").alias("parent"), F.col("level").alias("above"))
    inherited = links.join(parents, "parent").groupBy("record_table", "record_key", "ref", "holder", "period").agg((F.min("above") + 1).alias("level"))
    return broken.withColumn("level", F.lit(0)).unionByName(inherited), holders


def report(refs: DataFrame) -> DataFrame:
    """(record_table, period, kind, refs, records): orphaned references per table and month, and the records that hold them."""
    month, kind = F.date_format("period", "yyyy-MM").alias("period"), F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind")
    per_record = refs.groupBy("record_table", month, kind, "record_key").agg(F.count_distinct("ref").alias("n"))
    return per_record.groupBy("record_table", "period", "kind").agg(F.sum("n").alias("refs"), F.count("*").alias("records"))
