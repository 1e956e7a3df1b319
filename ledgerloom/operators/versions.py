"""Versions, duplicates and collections. Edges are (new, old); items have an id and a size (null: not complete)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.terms import hash_id
from ledgerloom.operators.graph import descendants
from ledgerloom.scratch import discard, materialize


def next_versions(edges: DataFrame, items: DataFrame, members: DataFrame | None = None, now=None) -> DataFrame:
    """(id, next): direct successors that are complete and, at ``now``, not under embargo; a plain collection stands for its
    members. items: id, size, and embargo_until where ``now`` is given; members: coll, member (plain ones)."""
    steps = edges.select(F.col("old").alias("id"), F.col("new").alias("next"))
    if members is not None:
        inner = steps.join(members.select(F.col("coll").alias("next"), "member"), "next").select("id", F.col("member").alias("next"))
        steps = steps.join(members.select(F.col("coll").alias("next")).distinct(), "next", "left_anti").select("id", "next").union(inner)
    ready = items.where("size is not null")
    if now is not None:
        ready = ready.where(~F.coalesce(F.col("embargo_until") > F.lit(now).cast("timestamp"), F.lit(False)))
    return steps.join(ready.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next").distinct()


def is_complete(items: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """(id, complete): a collection is; a plain one if a member is; an object if it has a size. collections: id, plain."""
    sized = items.select("id", F.col("size").isNotNull().alias("complete"))
    plain = members.join(sized.withColumnRenamed("id", "member"), "member", "left").groupBy(F.col("coll").alias("id")).agg(F.max(F.coalesce("complete", F.lit(True))).alias("any"))
    colls = collections.join(plain, "id", "left").select("id", F.when(F.col("plain"), F.coalesce("any", F.lit(False))).otherwise(True).alias("complete"))
    return sized.union(colls)


def latest_versions(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(id, latest, in_cycle): all ends of the successor graph, the item itself if it has none. Path doubling: an id points at
    what is 1, 2, 4, ... steps ahead, or at ends nearer than that, so that a chain's pointers stay as many as its objects.
    Where no end can be reached the item itself is given, marked as in a cycle; rounds stop where no chain can be longer."""
    step = edges.select(F.col("old").alias("id"), F.col("new").alias("at")).where("id <> at").distinct()
    step = materialize(step, "steps")
    starts = step.select("id").distinct()
    open_ = materialize(step.join(starts.select(F.col("id").alias("at")), "at", "left_semi").select("id", "at"), "open")
    ends = materialize(step.join(starts.select(F.col("id").alias("at")), "at", "left_anti").select("id", "at"), "ends")
    for _ in range(step.count().bit_length() + 1):
        if open_.isEmpty():
            break
        jump = open_.alias("a")
        ahead = jump.join(open_.alias("b"), F.col("a.at") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.at").alias("at")).distinct()
        found = jump.join(ends.alias("e"), F.col("a.at") == F.col("e.id")).select(F.col("a.id").alias("id"), F.col("e.at").alias("at"))
        before = (open_, ends)
        open_, ends = materialize(ahead, "open"), materialize(ends.union(found).distinct(), "ends")
        discard(*before)
    ends = ends.select("id", F.col("at").alias("latest"), F.lit(False).alias("in_cycle"))
    rest = items.select("id").distinct().join(ends.select("id").distinct(), "id", "left_anti")
    return ends.union(rest.join(starts.withColumn("cycle", F.lit(True)), "id", "left").select("id", F.col("id").alias("latest"), F.coalesce("cycle", F.lit(False)).alias("in_cycle")))


def previous_versions(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, previous): direct predecessors, also through plain collections that hold the item."""
    own = edges.select(F.col("new").alias("id"), F.col("old").alias("previous"))
    if members is None:
        return own.distinct()
    through = members.join(edges.select(F.col("new").alias("coll"), "old"), "coll").select(F.col("member").alias("id"), F.col("old").alias("previous"))
    return own.union(through).distinct()


def version_chains(edges: DataFrame) -> DataFrame:
    """(id, chain, position, length) of objects in version chains without branches; the chain's name is its last object.
    Objects in a cycle have neither: their chain, position and length are null."""
    step = edges.select(F.col("old").alias("id"), F.col("new").alias("at"), F.lit(1).cast("long").alias("steps"))
    every = edges.select(F.col("new").alias("id")).union(edges.select("old")).distinct()
    state = materialize(every.join(step, "id", "left").select("id", F.coalesce("at", "id").alias("at"), F.coalesce("steps", F.lit(0)).alias("steps")), "chain")
    for _ in range(state.count().bit_length() + 1):
        two = state.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        old, state = state, materialize(state.join(two, "at").select("id", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps")), "chain")
        same = state.join(old.select("id", F.col("at").alias("was")), "id").where("at <> was").isEmpty()
        discard(old)
        if same:
            break
    last = state.join(step.select(F.col("id").alias("at"), F.lit(True).alias("goes_on")).distinct(), "at", "left")
    last = last.select("id", F.when(F.col("goes_on").isNull(), F.col("at")).alias("chain"), "steps")
    w = Window.partitionBy("chain")
    whole = F.col("chain").isNotNull()
    return last.select("id", "chain", F.when(whole, F.max("steps").over(w) - F.col("steps") + 1).cast("int").alias("position"), F.when(whole, F.max("steps").over(w) + 1).cast("int").alias("length"))


def bad_branches(edges: DataFrame, items: DataFrame, days: int = 60, span: int = 366) -> DataFrame:
    """(old, bad, id): of an object ``old`` with exactly two successors, those that are ``bad``, and all of the chain that begins
    with them. A successor is bad if it was itself replaced, by one other, more than ``days`` after its submission, or if what its
    chain ends with covers more than ``span`` days. items: id, submitted, data_start, data_end."""
    links = edges.select("old", "new").distinct()
    counts = links.groupBy("old").agg(F.count("*").alias("n"))
    nexts = materialize(links.join(counts.where("n = 2"), "old").select("old", F.col("new").alias("bad")), "branches")
    walk = materialize(nexts.select("bad", F.col("bad").alias("id")).distinct(), "walk")
    frontier = walk
    while True:  # a step of the chains each
        ahead = frontier.join(links.select(F.col("old").alias("id"), "new"), "id").select("bad", F.col("new").alias("id")).distinct()
        frontier = materialize(ahead.join(walk, ["bad", "id"], "left_anti"), "walk")
        if frontier.isEmpty():
            break
        walk = materialize(walk.union(frontier), "walk")
    t = items.select("id", "submitted")
    once = links.join(counts.where("n = 1").select("old"), "old").join(t.select(F.col("id").alias("old"), F.col("submitted").alias("t_old")), "old").join(t.select(F.col("id").alias("new"), F.col("submitted").alias("t_new")), "new")
    late = once.where(F.unix_seconds(F.col("t_new").cast("timestamp")) - F.unix_seconds(F.col("t_old").cast("timestamp")) > 86_400 * days).select(F.col("old").alias("bad"))
    ends = walk.join(links.select(F.col("old").alias("id")), "id", "left_anti").join(items, "id")
    wide = ends.where(F.unix_seconds(F.col("data_end").cast("timestamp")) - F.unix_seconds(F.col("data_start").cast("timestamp")) > 86_400 * span).select("bad")
    return nexts.join(late.union(wide).distinct(), "bad", "left_semi").join(walk, "bad").select("old", "bad", "id").distinct()


def multi_deprecated(edges: DataFrame) -> DataFrame:
    """Objects replaced more than once, and how often."""
    return edges.groupBy("old").agg(F.countDistinct("new").alias("n")).where("n > 1")


def chain_duplicates(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(new, old) links for groups of exactly two current objects (with a size, not deprecated) of a key, by submission."""
    w = Window.partitionBy(*keys)
    current = objects.where("size is not null and not deprecated")
    rows = current.withColumn("n", F.count("*").over(w)).withColumn("old", F.lag("id").over(w.orderBy("submitted", "id"))).where("n = 2 and old is not null")
    return rows.select(F.col("id").alias("new"), "old")


def deprecation_candidates(old: DataFrame, new: DataFrame, spec_map: DataFrame, keys: list[str]) -> DataFrame:
    """(new, old) by mapped spec (old_spec, new_spec) and equal keys."""
    a = old.select(F.col("id").alias("old"), F.col("spec").alias("old_spec"), *keys).join(spec_map, "old_spec")
    return a.join(new.select(F.col("id").alias("new"), F.col("spec").alias("new_spec"), *keys), ["new_spec", *keys]).select("new", "old")


def interval_deprecations(old: DataFrame, new: DataFrame, height: float = 2.0, days: int = 32) -> DataFrame:
    """(new, old): complete objects of the same station and spec, heights less than ``height`` apart, the new interval covers that
    of an old one that isn't deprecated. A new interval is dealt to all stretches of ``days`` that it touches, an old one to that
    in which it starts."""
    part = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86_400 * days))
    a = old.where("not deprecated and size is not null").withColumn("_part", part("data_start")).alias("a")
    b = new.where("data_start <= data_end and size is not null").withColumn("_part", F.explode(F.sequence(part("data_start"), part("data_end")))).alias("b")
    covers = (F.col("b.data_start") <= F.col("a.data_start")) & (F.col("b.data_end") >= F.col("a.data_end"))
    same = (F.col("a._part") == F.col("b._part")) & (F.col("a.station") == F.col("b.station")) & (F.col("a.spec") == F.col("b.spec")) & (F.col("a.id") != F.col("b.id"))
    return a.join(b, same & covers & (F.abs(F.col("a.height") - F.col("b.height")) < height)).select(F.col("b.id").alias("new"), F.col("a.id").alias("old"))


def shrunk_versions(edges: DataFrame, items: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(id, latest, loss): latest versions smaller than ``threshold`` times the older; loss in whole percents."""
    size = items.where("size is not null").select("id", "size")
    rows = latest_versions(edges, items).where("id <> latest").join(size, "id").join(size.select(F.col("id").alias("latest"), F.col("size").alias("new_size")), "latest")
    return rows.where(F.col("new_size") < F.col("size") * threshold).select("id", "latest", F.floor((F.col("size") - F.col("new_size")) * 100 / F.col("size")).alias("loss"))


def same_name_latest(objects: DataFrame, k: int = 2, name: str = "file_name") -> DataFrame:
    """The newest k objects of each file name, with their rank."""
    w = Window.partitionBy(name).orderBy(F.desc("submitted"), F.desc("id"))
    return objects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def archive_completeness(zip_members: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """zip_members: package, version, member, md5, ts. (package, member, md5) of the newest contents, and (package, version, member, problem) of versions that lack or differ."""
    newest = zip_members.groupBy("package", "member").agg(F.max_by("md5", F.struct("ts", "md5")).alias("md5"))
    wanted = versions.select("package", "version").distinct().join(newest, "package")
    own = zip_members.select("package", "version", "member", F.col("md5").alias("own"))
    bad = wanted.join(own, ["package", "version", "member"], "left").where("own is null or own <> md5")
    return newest, bad.select("package", "version", "member", F.when(F.col("own").isNull(), "missing").otherwise("older").alias("problem"))


def archive_repairs(zip_members: DataFrame, versions: DataFrame) -> DataFrame:
    """(package, version, action): ``purge`` for versions after the first one (by ``ts`` of versions) that has all newest contents;
    where none has, but for the last one, ``take`` for versions that have all that the last one lacks."""
    newest, bad = archive_completeness(zip_members, versions)
    lacks = bad.groupBy("package", "version").agg(F.count("*").alias("lacks"))
    w = Window.partitionBy("package").orderBy("ts", "version")
    rows = versions.select("package", "version", "ts").distinct().join(lacks, ["package", "version"], "left").withColumn("nr", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy("package")))
    rows = rows.withColumn("first_whole", F.min(F.when(F.col("lacks").isNull(), F.col("nr"))).over(Window.partitionBy("package")))
    purge = rows.where("first_whole < last and nr > first_whole").select("package", "version", F.lit("purge").alias("action"))
    open_ = rows.where("first_whole is null")
    wanted = bad.join(open_.where("nr = last").select("package", "version"), ["package", "version"]).select("package", "member")
    number = wanted.groupBy("package").agg(F.count("*").alias("wanted"))
    still = bad.select("package", "version", "member").join(wanted, ["package", "member"]).select("package", "version").distinct()
    take = open_.join(number, "package").join(still, ["package", "version"], "left_anti").select("package", "version", F.lit("take").alias("action"))
    return purge.union(take)


def parent_collections(members: DataFrame, coll_edges: DataFrame) -> DataFrame:
    """(member, coll): collections that hold the item and aren't replaced by another that holds it."""
    held = members.select("member", "coll").distinct()
    replaced = held.join(coll_edges.select(F.col("old").alias("coll"), F.col("new").alias("newer")), "coll").join(held.select("member", F.col("coll").alias("newer")), ["member", "newer"], "left_semi").select("member", "coll")
    return held.join(replaced, ["member", "coll"], "left_anti")


def collection_rollup(members: DataFrame, objects: DataFrame, **listed: DataFrame) -> DataFrame:
    """(coll, n_objects, and a sorted list for each of ``listed``) over all objects below a collection, through inner ones.

    members: coll, member; objects: id; listed: for each name a table (id, value), as creators, funders, subjects or formats.
    Only links between collections are followed, level by level; objects are joined once, at the end. A collection in a cycle
    has all objects of the cycle."""
    direct = members.select("coll", "member").distinct()
    inner = direct.join(direct.select(F.col("coll").alias("member")).distinct(), "member", "left_semi").select(F.col("coll").alias("top"), F.col("member").alias("below"))
    reach = descendants(inner).select(F.col("top").alias("coll"), F.col("below").alias("under"))
    reach = reach.union(direct.select("coll", F.col("coll").alias("under")).distinct())
    held = direct.join(objects.select(F.col("id").alias("member")), "member", "left_semi").withColumnRenamed("coll", "under")
    below = materialize(reach.join(held, "under").select("coll", F.col("member").alias("id")).distinct(), "below")
    out = below.groupBy("coll").agg(F.count("*").alias("n_objects"))
    for name, table in listed.items():
        values = below.join(table.select("id", F.col("value").cast("string").alias("value")), "id").select("coll", "value").where("value is not null").distinct()
        out = out.join(values.groupBy("coll").agg(F.array_sort(F.collect_list("value")).alias(name)), "coll", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def collection_hash(members: DataFrame) -> DataFrame:
    """(coll, hash): SHA-256 over the members' hashes (``hash``: base64url ids of 24 characters), sorted by id."""
    raw = F.unbase64(F.translate("hash", "-_", "+/"))
    rows = members.groupBy("coll").agg(F.array_sort(F.collect_set(F.struct("hash", F.hex(raw).alias("raw")))).alias("l"))
    return rows.select("coll", F.sha2(F.unhex(F.array_join(F.transform("l", lambda x: x.raw), "")), 256).alias("hash"))


def superseded_references(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (subj, obj) to an object that has a newer version."""
    return links.join(edges.select(F.col("old").alias("obj")).distinct(), "obj", "left_semi")


def release_collections(objects: DataFrame, spec: int, since, collections: DataFrame | None = None) -> DataFrame:
    """(station, members, previous): per station the current objects (with a size, not deprecated) of a release, and, where
    ``collections`` (coll, member; current ones) are given, the last one whose members all are of this station."""
    rows = objects.where((F.col("spec") == spec) & (F.col("submitted") >= F.lit(since).cast("timestamp")) & F.col("station").isNotNull() & F.col("size").isNotNull() & ~F.col("deprecated"))
    out = rows.groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("members"))
    if collections is None:
        return out
    placed = collections.join(objects.where("station is not null").select(F.col("id").alias("member"), "station"), "member")
    single = placed.groupBy("coll").agg(F.min("station").alias("station"), F.max("station").alias("most")).where("station = most")
    return out.join(single.groupBy("station").agg(F.max("coll").alias("previous")), "station", "left")


def links_from_table(rows: DataFrame, new_hash: str, old_hash: str) -> tuple[DataFrame, DataFrame]:
    """((new, old), (old, n)) of a delimited list with hashes in any notation: the links, and the old objects named more than
    once. If there are any of those, the list is refused: it has no links. Rows without an old hash, or with a text that isn't
    a hash, name no link."""
    ids = rows.select(hash_id(F.col(new_hash)).alias("new"), hash_id(F.col(old_hash)).alias("old")).where("new is not null and old is not null")
    twice = ids.groupBy("old").agg(F.count("*").alias("n")).where("n > 1")
    refused = twice.select(F.lit(1).alias("_one")).limit(1)
    return ids.withColumn("_one", F.lit(1)).join(F.broadcast(refused), "_one", "left_anti").select("new", "old"), twice
