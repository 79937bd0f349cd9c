"""Operator 6: benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of `window` words. Containment must be whole, so one shingle of a window is a
sufficient prefix: its rarest, by count over all documents. Documents are searched for those shingles only; a find must
lie so that the window fits into the document (positional and length bounds) and is then compared word by word.
Null and empty texts have no words. An item of fewer words than a window is one window; an item without words is none.
Items that repeat are one item by their id; items without an id are searched like others. Repeated documents are
searched like others and get equal results; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_key

WINDOW, SHINGLE = 10, 3
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Up to so many shingles are looked up as a set of constants in each row; more are joined.
INLINE = 50_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _hash(array: str, at: str, s: int) -> str:
    return f"xxhash64({', '.join(f'{array}[{at} + {k}]' for k in range(s))})"


def _shingles(array: str, s: int) -> str:
    """The hashed shingles of s words of an array, by position."""
    return f"if(size({array}) < {s}, cast(array() as array<bigint>), transform(sequence(0, size({array}) - {s}), i -> {_hash(array, 'i', s)}))"


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: win (words), items (structs of the ids, as strings, that have it; an id may be null)."""
    own = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    cut_up = F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")
    return own.select("item", F.explode(cut_up).alias("win")).groupBy("win").agg(F.collect_set(F.struct("item")).alias("items"))


def _with_words(body: str) -> Column:
    """An expression over the words w, held in a lambda's variable: the optimiser can't make them anew at each use."""
    return F.expr(f"transform(array(w), w -> {body})")[0]


def _placed(sizes: list[int]) -> Column:
    """All shingles of w of so many words, as (s, h, p)."""
    each = [f"transform({_shingles('w', s)}, (h, p) -> struct({s} as s, h as h, p as p))" for s in sizes]
    return _with_words(f"concat({', '.join(each)})")


def _among(by_size: dict[int, list[int]]) -> Column:
    def known(x: Column) -> Column:
        found = F.lit(False)
        for s, hashes in by_size.items():
            found = found | ((x["s"] == s) & x["h"].isin(hashes))
        return found

    return F.filter(_placed(list(by_size)), known)


def _found(texts: DataFrame, sought: DataFrame, sizes: list[int], inline: int) -> DataFrame:
    """texts (w and others) with x: the sought shingles (s words, hash h) in w, each at word p. One pass over the texts.

    Up to `inline` of them are looked up as constants; more are joined, and texts then need a column k that is a key of w.
    """
    if sought.count() <= inline:
        by_size: dict[int, list[int]] = {s: [] for s in sizes}
        for r in sought.collect():  # at most `inline` numbers
            by_size[r["s"]].append(r["h"])
        return texts.withColumn("x", _among(by_size))
    narrow = texts.select("k", F.inline(_placed(sizes))).join(sought, ["s", "h"], "left_semi").distinct()
    none = F.expr("cast(array() as array<struct<s:int,h:bigint,p:int>>)")
    return texts.join(narrow.groupBy("k").agg(F.collect_list(F.struct("s", "h", "p")).alias("x")), "k", "left").withColumn("x", F.coalesce("x", none))


def _search(docs: DataFrame, items: DataFrame, window: int, text: str, inline: int, key: str | None) -> tuple[DataFrame, DataFrame] | None:
    """(rows, hits): rows are k and n_words of docs' rows, with key all of them and that column too; hits as hits() has them."""
    own = [F.col(key).alias("doc_id")] if key else []
    tokens = docs.select(*own, text_key(F.col(text)).alias("k"), words(F.col(text)).alias("w"))
    wins = cut(item_windows(items, window).withColumn("s", F.least(F.size("win"), F.lit(SHINGLE))))
    sizes = sorted(r[0] for r in wins.select("s").distinct().collect())  # SHINGLE numbers at most
    if not sizes:
        return None
    placed = cut(wins.select("win", "items", "s", F.posexplode(F.expr("CASE s " + " ".join(f"WHEN {s} THEN {_shingles('win', s)}" for s in sizes) + " END")).alias("o", "h")))
    # explode_outer: explode would have the array made once more, to see whether it is empty
    every = _found(tokens.select("k", "w"), placed.select("s", "h").distinct(), sizes, inline).select(F.explode_outer("x").alias("x"))
    rarity = cut(every.where("x is not null").groupBy("x.s", "x.h").count())
    ranked = placed.join(rarity, ["s", "h"], "left").groupBy("win", "s").agg(F.min(F.struct("count", "o", "h")).alias("x"), F.first("items").alias("items"))
    # a window with a shingle that no document has (its count is null, which sorts first) can't occur
    prefix = cut(ranked.where("x.count is not null").select("win", "items", "s", "x.o", "x.h"))
    around = _with_words(f"transform(x, y -> struct(y.s as s, y.h as h, y.p as p, greatest(y.p - {window}, 0) as b, slice(w, greatest(y.p - {window}, 0) + 1, {2 * window + SHINGLE}) as c))")
    texts = _found(tokens, prefix.select("s", "h").distinct(), sizes, inline).select(*(["doc_id"] if key else []), "k", F.size("w").alias("n"), around.alias("x"))
    rows = cut(texts if key else texts.where(F.size("x") > 0))
    fits = (F.col("p") >= F.col("o")) & (F.col("p") - F.col("o") + F.size("win") <= F.col("n")) & (F.expr("slice(c, greatest(p - o - b, 0) + 1, size(win))") == F.col("win"))
    found = rows.select("k", "n", F.inline("x")).join(prefix, ["s", "h"]).where(fits).select("k", (F.col("p") - F.col("o")).alias("lo"), F.size("win").alias("size"), F.explode("items").alias("item"))
    gathered = found.groupBy("k").agg(F.collect_set(F.struct("lo", "size")).alias("at"), F.collect_set("item").alias("own"))
    # the words hit, in order; a span begins where the word before is not hit
    covered = gathered.withColumn("c", F.expr("array_sort(array_distinct(flatten(transform(at, x -> sequence(x.lo, x.lo + x.size - 1)))))"))
    begins, ends = F.expr("filter(c, (x, i) -> i = 0 OR c[i - 1] < x - 1)"), F.expr("filter(c, (x, i) -> i = size(c) - 1 OR c[i + 1] > x + 1)")
    hit = covered.select(
        "k",
        F.size("c").cast("long").alias("n_hit"),
        F.zip_with(begins, ends, lambda x, y: F.struct(x.alias("lo"), (y + 1).alias("hi"))).alias("spans"),
        F.expr("array_sort(filter(own.item, x -> x IS NOT NULL))").alias("items"),
        F.size("own").cast("long").alias("n_items"),
    )
    return rows, hit


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", inline: int = INLINE) -> DataFrame:
    """Per distinct text with hits: k (its 16-byte key), n_hit, spans (start, end in words; merged), items (sorted ids) and n_items.

    Items without an id are one item more in n_items and hit like others.
    """
    found = _search(docs, items, window, text, inline, None)
    return found[1] if found else docs.sparkSession.createDataFrame([], "k binary, n_hit long, spans array<struct<lo:int,hi:int>>, items array<string>, n_items long")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for every row of docs, as the contract has it."""
    found = _search(docs, items, window, "text", INLINE, "doc_id")
    none = F.lit(0).cast("long")
    if found is None:
        joined = docs.select("doc_id", F.size(words(F.col("text"))).alias("n"), none.alias("n_hit"), none.alias("n_items"), F.lit(None).cast("array<string>").alias("items"))
    else:
        joined = found[0].join(found[1], "k", "left")
    n_hit = F.coalesce("n_hit", none)
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    return docs.withColumn("__k", text_key(F.col("text"))).join(hits(docs, items, window).select(F.col("k").alias("__k")), "__k", "left_anti").select(*docs.columns)
