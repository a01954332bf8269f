"""Caches, libraries and model files: sizes, eviction to a cap, pruning, sorting, deduplication, presence."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.groups import folded
from ..plans.prefix import numbered, running_sum


def folder_sizes(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """dir, size_bytes, files of each folder."""
    return files.groupBy(S.parent(F.col(path)).alias("dir")).agg(F.sum(length).cast("long").alias("size_bytes"), F.count("*").alias("files"))


def with_metadata(entries: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Entries with their metadata where there is any; `age_key` is the last use, else the modification time."""
    return entries.join(meta, key, "left").withColumn("age_key", F.coalesce("last_used", "mtime"))


def evict_to_cap(entries: DataFrame, cap: int, size: str, age: str, ident: str, protected: str | None = None) -> DataFrame:
    """Entries to delete: the oldest first, until the rest is within the cap; protected ones are neither counted nor
    deleted; a cap of 0 or less deletes nothing. The running size is summed in parallel; further columns stay."""
    free = entries if protected is None else entries.where(~F.coalesce(F.col(protected), F.lit(False)))
    if cap <= 0:
        return free.limit(0)
    total = free.agg(F.sum(size).alias("_all"))
    run = running_sum(free, size, [F.col(age), F.col(ident)], "_upto")
    return run.join(F.broadcast(total)).where(F.col("_all") - (F.col("_upto") - F.col(size)) > cap).drop("_all", "_upto")


def clear_but(entries: DataFrame, protect: DataFrame, key: str) -> DataFrame:
    return entries.join(protect.select(key), key, "left_anti")


def prune_to_count(items: DataFrame, cap: int, age: str, ident: str, slack: float = 1.1, puts: int | None = None, every: int = 100) -> DataFrame:
    """Items to delete, oldest first, so that `cap` stay; none until there are over `slack` times as many.

    With `puts` (how many were written so far) only every so many of them prune. Items are counted in parallel.
    """
    n = items.count()
    if n <= cap * slack or (puts is not None and puts % every):
        return items.limit(0)
    run = numbered(items, [F.col(age), F.col(ident)], "_place")
    return run.where(F.col("_place") <= n - cap).drop("_place")


class _Lru:
    """Sizes by item, the least recently used first, and their sum."""

    def __init__(self) -> None:
        self.sizes: OrderedDict = OrderedDict()
        self.held = 0

    def evict(self, budget: int) -> None:
        while self.held > budget:
            self.held -= self.sizes.popitem(last=False)[1]


def lru_trace(trace: DataFrame, key: str, seq: str, op: str, item: str, size: str, budget: int) -> DataFrame:
    """A byte-budget cache replayed over the steps of each key: hit and bytes held after each step.

    Gets touch, tests (`has`) don't; puts replace; items over the budget are not kept; `resize` sets the budget to the
    step's size and evicts to fit. Sequential within a key by definition; of a key only its cache is kept in memory.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        cache, most = state
        at, what, thing, n = row
        hit = None
        if what in ("get", "has"):
            hit = thing in cache.sizes
            if hit and what == "get":
                cache.sizes.move_to_end(thing)
        elif what == "resize":
            most = n
            cache.evict(most)
        elif n <= most:
            cache.held += n - cache.sizes.pop(thing, 0)
            cache.sizes[thing] = n
            cache.evict(most)
        return (cache, most), [(at, hit, cache.held)]

    return folded(trace.select(key, seq, op, item, size), [key], [seq], lambda: (_Lru(), budget), step, f"{seq} long, hit boolean, held long")


def library(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with name, ext and kind."""
    p = F.col(path)
    return files.withColumns({"name": F.lower(F.regexp_extract(p, r"([^/]*)$", 1)), "ext": S.extension(p), "kind": S.media_kind(p)})


#: Sort fields and what an unknown value counts as.
SORTS = {"name": None, "path": None, "mtime": float("-inf"), "size_bytes": -1, "pixel_count": -1}


def sorted_library(items: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Items by a field, ties by path; unknown whole numbers count as -1, unknown times as before all others."""
    if field not in SORTS:
        raise ValueError(field)
    c = F.col(field) if SORTS[field] is None else F.coalesce(F.col(field), F.lit(SORTS[field]))
    return items.orderBy(c.desc() if descending else c.asc(), "path")


def caption_filter(items: DataFrame, caption: str, text: str) -> DataFrame:
    """Items whose caption holds the text, case aside, no pattern."""
    return items.where(F.contains(F.lower(F.coalesce(F.col(caption), F.lit(""))), F.lower(F.lit(text)))) if text else items


def first_by_path(items: DataFrame, path: str, order: str) -> DataFrame:
    """One item for each path, the first in order."""
    rest = [c for c in items.columns if c != path]
    return items.groupBy(path).agg(F.min_by(F.struct(*rest), order).alias("r")).select(path, *[f"r.{c}" for c in rest])


def coalesced_requests(requests: DataFrame, path: str, work) -> DataFrame:
    """Each distinct path is worked on once; the result goes to all requests of it."""
    return requests.join(work(requests.select(path).distinct()), path, "left")


def missing(catalogue: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Catalogue rows without a non-empty file."""
    return catalogue.join(present.where(F.col("length") > 0).select(key), key, "left_anti")


def looked_up(names: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """`names` with what the catalogue knows of each; `known` tells whether it does."""
    return names.join(catalogue.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def catalogue_entries(catalogue: DataFrame, category: str, name: str, categories: list[str]) -> DataFrame:
    """`catalogue` with `place` (from 1): by category in the given order (others come last, by name), then by name, case aside."""
    at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category))
    order = [F.when(at > 0, at).otherwise(F.lit(len(categories) + 1)), F.when(at > 0, "").otherwise(F.col(category)), F.lower(name), F.col(name)]
    return numbered(catalogue, order, "place")


def section_label(items: DataFrame, folder: str, roots: list[str]) -> DataFrame:
    """`items` with `section`: the folder relative to the root that makes it shortest, else the folder."""
    c = F.col(folder)
    rel = [F.when(c == r, F.regexp_extract(F.lit(r), r"([^/]*)$", 1)).when(c.startswith(r + "/"), F.substr(c, F.lit(len(r) + 2))) for r in roots]
    arr = F.filter(F.array(*rel), lambda x: x.isNotNull()) if roots else F.array().cast("array<string>")
    best = F.array_min(F.transform(arr, lambda x: F.struct(F.size(F.split(x, "/")).alias("n"), x.alias("x"))))
    return items.withColumn("section", F.coalesce(best["x"], c))


def in_folder(items: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Items that lie in a folder itself."""
    return items.where(S.parent(F.col(path)) == folder)


def by_folder(items: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """folder, section, items, place: folders in order of their lower-case names, numbered from 1.

    Only one row a folder is put in order, in ranges.
    """
    f = items.groupBy(S.parent(F.col(path)).alias("folder")).agg(F.count("*").alias("items"))
    f = section_label(f, "folder", roots)
    return numbered(f, [F.lower("folder"), F.col("folder")], "place")


def thumbnail_states(requests: DataFrame, files: DataFrame, cache: DataFrame, path: str = "path") -> DataFrame:
    """`requests` with state: not found, unsupported, cached, or render."""
    j = requests.join(files.select(path, F.lit(True).alias("_file")).distinct(), path, "left").join(cache.select(path, F.lit(True).alias("_cached")).distinct(), path, "left")
    state = F.when(F.col("_file").isNull(), "not found").when(S.media_kind(F.col(path)) == "other", "unsupported").when(F.col("_cached"), "cached").otherwise("render")
    return j.withColumn("state", state).drop("_file", "_cached")


def upkeep(library: DataFrame, changes: DataFrame, path: str = "path") -> DataFrame:
    """path, thumbnail, error after changes (seq, op, path, value): add, remove, thumbnail (clears an error) or failure.

    The last add or remove of a path says whether it is there; results of a path that was removed since don't count.
    """
    base = library.select(path, "thumbnail", "error").withColumn("seq", F.lit(-1).cast("long"))
    c = changes.withColumn("seq", F.col("seq").cast("long"))
    every = base.select(path, "seq", F.lit("add").alias("op"), F.lit(None).cast("string").alias("value")).unionByName(c.select(path, "seq", "op", "value"))
    edit = F.col("op").isin("add", "remove")
    last = every.groupBy(path).agg(
        F.max_by("op", F.when(edit, F.col("seq"))).alias("there"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("gone_at"),
        F.max(F.when(~edit, F.struct("seq", "op", "value"))).alias("r"))
    d = last.where("there = 'add'").join(base.drop("seq"), path, "left")
    new = F.col("r").isNotNull() & F.coalesce(F.col("r.seq") > F.col("gone_at"), F.lit(True))
    old = F.col("gone_at").isNull()
    thumb = F.when(new & (F.col("r.op") == "thumbnail"), F.col("r.value")).when(old, F.col("thumbnail"))
    error = F.when(new & (F.col("r.op") == "failure"), F.col("r.value")).when(new, F.lit(None)).when(old, F.col("error"))
    return d.select(path, thumb.alias("thumbnail"), error.alias("error"))
