"""Benchmark decontamination by canonical template windows and slot consistency."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .words import CHUNK_BYTES, mix, whole_windows, window_hashes, word_hashes

WINDOW = 8
#: Shorter items cannot be told from chance inside other text: they match texts that are nothing but the item.
SHORTEST = 4
#: Windows with fewer tokens outside slots match by their whole text: a row of numbers is no template.
LEAST_WORDS = 3
#: Consecutive matching windows that make a leak (fewer where the item has fewer).
ENOUGH = 5
#: Bound on the benchmark windows that are sent to every task; beyond it documents' windows are shuffled instead, with
#: the same result.
MAX_SENT = 1_000_000

#: A number is one token, with its separators and decimals.
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]{3}(?![0-9]))*(?:[.,][0-9]+)?[^\W_]*|[^\W_]+")
#: Words with a typed placeholder (fixed values); tokens that begin with a digit are numbers too.
ONES = "one two three four five six seven eight nine".split()
TEENS = "zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
POWERS = "hundred thousand million".split()
NUMBERS = ONES + TEENS + TENS + POWERS
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg gram grams kilogram kilograms "
    "lb lbs pound pounds ounce ounces ton tons liter liters litre litres ml gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent degree degrees"
).split()
NAMES = (
    "alice andrew anna anthony barbara ben bob carlos carol charles chris christopher claire daniel david emily emma eric frank george hannah "
    "helen henry jack jacob james jane jennifer jessica jim joe john jose joseph juan julia karen kate kevin laura linda lisa lucy maria marie "
    "mark martin mary michael mike natalia nicole olivia paul peter rachel richard robert sam sandra sarah sophie steve susan thomas tim tina tom weng william"
).split()
#: Number words that others may follow, and what each may be followed by.
LEADS, FOLLOWS = frozenset(TENS + POWERS), dict.fromkeys(TENS, frozenset(ONES)) | dict.fromkeys(POWERS, frozenset(NUMBERS))
SLOTS = dict.fromkeys(NUMBERS, "\x01num") | dict.fromkeys(UNITS, "\x01unit") | dict.fromkeys(NAMES, "\x01name")


def _whole_numbers(tokens: list[str]) -> list[str]:
    """The tokens, with number words that make one number ("twenty-five", "two hundred and six") as one."""
    out, last = [], ""
    for i, t in enumerate(tokens):
        follows = t in FOLLOWS.get(last, ()) or t in POWERS and (last in SLOTS and SLOTS[last] == "\x01num" or last[:1].isdecimal())
        if follows or t == "and" and last in POWERS and tokens[i + 1 : i + 2] and tokens[i + 1] in NUMBERS:
            out[-1] += " " + t
            last = t if follows else last
        else:
            out.append(t)
            last = t
    return out


#: A capitalised word inside a sentence. The capital comes first and what is before it after that, as a search for a class is fast.
INNER_CAPITAL = re.compile(r"[A-ZÀ-Þ](?<=[^\W\d_A-Z] .|[0-9,;] .)[a-zß-ÿ]+(?![^\W_])")


def canonical(text: str) -> tuple[list[str], list[str]]:
    """Lower-cased tokens, and the same with placeholders in the slots."""
    tokens = TOKEN.findall(text.lower())
    get = SLOTS.get
    if not LEADS.isdisjoint(tokens):
        tokens = _whole_numbers(tokens)
        return tokens, ["\x01num" if t[0] in "0123456789" or " " in t else get(t, t) for t in tokens]
    return tokens, ["\x01num" if t[0] in "0123456789" else get(t, t) for t in tokens]


def with_capitals(text: str, forms: list[str]) -> list[str] | None:
    """``forms`` with a name slot for each word that the text has capitalised inside a sentence, as names beyond the
    list are; None if there is none."""
    names = {w.lower() for w in INNER_CAPITAL.findall(text)} - SLOTS.keys()
    return ["\x01name" if f in names else f for f in forms] if names else None


def _hashes(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token of all documents, the number of each document's first token, and which tokens are placeholders."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    if not first[-1]:
        return np.zeros(0, np.uint64), first, np.zeros(0, bool)
    data = np.frombuffer("\x02".join("\x02".join(d) for d in docs if d).encode("utf-8", "surrogatepass"), np.uint8)  # no token has it
    cuts = np.flatnonzero(data == 2)
    starts, ends = np.concatenate([[0], cuts + 1]), np.append(cuts, len(data))
    return word_hashes(data, starts, ends), first, data[starts] == 1


def template_of(tokens: list[str], forms: list[str]) -> tuple[int, list[str | None]]:
    """The class of an item, a hash of its forms and of which slots have values in common, and for each token its value's number, None
    outside slots. Items of one class differ in the values of their slots alone."""
    numbers: dict[str, str] = {}
    pattern = [numbers.setdefault(t, str(len(numbers))) if f[0] == "\x01" else None for t, f in zip(tokens, forms, strict=True)]
    text = "\x02".join([*forms, *(p or "" for p in pattern)])
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), pattern


def _windows(sizes: list[int], wanted: Broadcast | None, items: bool):
    """A mapInArrow function: rows (row, id, text) -> (row, id, family, pos, size, h, slots), one a window; of items also their class and
    the window's part of its pattern.

    Family 0 has the slots of the lists, family 1 those of capitalised words too. wanted: sorted hashes, others are left
    out. items: only the size that an item itself needs; else windows under SHORTEST only as whole texts.
    """

    def emit(b: pa.RecordBatch, at: list[int], tokens: list[list[str]], forms: list[list[str]], family: int, wanted: np.ndarray | None) -> pa.RecordBatch:
        h, first, slot = _hashes(forms)
        doc = np.repeat(np.arange(len(forms)), np.diff(first))
        literal = np.concatenate([[0], np.cumsum(~slot)])
        rows, pos, size, hs, slots, classes, patterns = [], [], [], [], [], [], []
        kinds = [template_of(t, f) for t, f in zip(tokens, forms, strict=True)] if items else None
        for k in sizes:
            starts = whole_windows(first, k)
            n = np.diff(first)[doc[starts]]
            if items and k < WINDOW or k < SHORTEST:
                starts = starts[n == k]
            if not len(starts):
                continue
            w = window_hashes(h, k)[starts]
            few = literal[starts + k] - literal[starts] < min(k, LEAST_WORDS)
            if few.any():
                some = starts[few]
                own = np.unique(doc[some])  # only their texts are hashed as they are
                plain, at_, _ = _hashes([tokens[d] for d in own])
                w[few] = mix(window_hashes(plain, k)[at_[np.searchsorted(own, doc[some])] + some - first[doc[some]]] + np.uint64(1))
            w = mix(w + np.uint64(16 * family + k))
            if wanted is not None:
                found = wanted[np.minimum(np.searchsorted(wanted, w), len(wanted) - 1)] == w if len(wanted) else np.zeros(len(w), bool)
                starts, w = starts[found], w[found]
            for s, x in zip(starts.tolist(), w.view(np.int64).tolist(), strict=True):
                d = int(doc[s])
                i = s - int(first[d])
                rows.append(at[d])
                pos.append(i)
                size.append(k)
                hs.append(x)
                slots.append([t for t, f in zip(tokens[d][i : i + k], forms[d][i : i + k], strict=True) if f[0] == "\x01"])
                if kinds:
                    classes.append(kinds[d][0])
                    patterns.append([p for p in kinds[d][1][i : i + k] if p is not None])
        take = pa.array(rows, pa.int64())
        cols = [b.column(0).take(take), b.column(1).take(take), pa.array([family] * len(rows), pa.int32()), pa.array(pos, pa.int64()), pa.array(size, pa.int64()), pa.array(hs, pa.int64()), pa.array(slots, pa.list_(pa.string()))]
        if kinds:
            cols += [pa.array(classes, pa.int64()), pa.array(patterns, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["row", "id", "family", "pos", "size", "h", "slots", "cls", "pattern"][: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = wanted.value if wanted is not None else None
        for b in batches:
            held: tuple[list, list] = ([], [])  # of each family: (number of the row, tokens, forms)
            n = 0
            for i, t in enumerate(b.column(2)):
                text = t.as_py() or ""
                tokens, forms = canonical(text)
                held[0].append((i, tokens, forms))
                if (more := with_capitals(text, forms)) is not None:
                    held[1].append((i, tokens, more))
                n += len(text)
                if n >= CHUNK_BYTES or i == b.num_rows - 1:
                    for family in (0, 1):
                        if held[family]:
                            yield emit(b, *map(list, zip(*held[family], strict=True)), family, hashes)
                    held, n = ([], []), 0

    return run


def template_windows(df: DataFrame, id_col: str, text_col: str, sizes: list[int], wanted: Broadcast | None = None, items: bool = False) -> DataFrame:
    """(row, id, family, pos, size, h, slots), of items also (cls, pattern); ``row`` tells rows apart whatever their ids."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = ", cls long, pattern array<string>" if items else ""
    return rows.mapInArrow(_windows(sizes, wanted, items), f"row long, id {id_type}, family int, pos long, size long, h long, slots array<string>{more}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, doc_start, n_matched, n_windows, exact, n_items), one row for each row of ``docs``, leaked template and place.

    Texts become lower-cased tokens with typed placeholders for numbers, names and units; windows of WINDOW tokens
    (all of an item that is shorter) are hash-joined. Windows of one row and item that match at one distance are a leak
    if ENOUGH consecutive ones (or all the item has) have the same text, or match and have slots that agree: each value
    of the item stands for one value of the document, and the reverse. ``exact`` tells copies from re-parameterised
    ones: all matching windows have the same text. Names are those of a list and, in a second family of windows, words capitalised inside a sentence.

    Items that differ in the values of their slots alone are one template and are joined as one, so a common template does not pair
    all its items with all documents. ``n_items`` tells how many items the template has; the item named is that whose values the
    matching windows have, else the template's first, by id and text. A window has the template's text if it has that of any of its items.

    Null or empty texts have no window. Rows are judged one by one, whatever their ids: null ids and repeated rows each
    give their own leaks. Items are told apart by id and text: those with a null id or with one id are found like others,
    repeated ones count once. Long texts are read whole, chunk by chunk. Empty tables: empty result. Other columns are not
    carried, so their names cannot clash.
    """
    spark = docs.sparkSession
    own = staged(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).dropDuplicates().withColumn("key", F.monotonically_increasing_id()), "leak-benchmark")
    items = staged(template_windows(own, "key", "text", list(range(1, WINDOW + 1)), items=True).drop("row"), "leak-items")
    items = items.select("cls", F.col("id").alias("key"), F.col("family").alias("ifamily"), F.col("pos").alias("at"), F.col("size").alias("isize"), F.col("h").alias("ih"), F.col("slots").alias("islots"), "pattern")
    window = ["cls", "ifamily", "at", "isize", "ih"]
    shapes = items.groupBy(*window).agg(F.min("pattern").alias("pattern"))
    said = items.groupBy(*window, "islots").agg(F.min("key").alias("said")).select(*(F.col(c).alias(f"s_{c}") for c in window), "islots", "said")
    sizes = [r[0] for r in items.select("isize").distinct().orderBy("isize").collect()]  # at most WINDOW
    small = items.count() <= MAX_SENT
    sent = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    first = F.min_by("key", F.struct(F.col("item").isNull(), "item", "text"))
    members = items.groupBy("cls", "key").agg(F.count_distinct("at").alias("n")).join(sent(own), "key")
    totals = members.groupBy(F.col("cls").alias("t_cls")).agg(F.max("n").alias("n_windows"), F.count(F.lit(1)).alias("n_items"), first.alias("first_key"))
    wanted = None
    if small:
        hashes = items.select("ih").distinct().toArrow().column(0).to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    found = staged(template_windows(docs, id_col, text_col, sizes, wanted), "leak-windows") if sizes else template_windows(docs.limit(0), id_col, text_col, [WINDOW])
    pairs = found.join(sent(shapes), (F.col("h") == F.col("ih")) & (F.col("size") == F.col("isize")) & (F.col("family") == F.col("ifamily")))
    alike = F.col("slots") == F.col("islots")
    for c in window:
        alike = alike & (F.col(c) == F.col(f"s_{c}"))
    pairs = pairs.join(sent(said), alike, "left")
    place = ["row", "id", "cls", "start", "family"]
    pairs = pairs.select("row", "id", "cls", "at", (F.col("pos") - F.col("at")).alias("start"), "family", "pattern", "slots", F.col("said").isNotNull().alias("same"), F.when(F.size("slots") > 0, F.struct(F.size("slots").alias("n"), (-F.col("said")).alias("said"))).alias("named"))
    # a diagonal has at most the item's windows
    nth = lambda *by: F.row_number().over(Window.partitionBy("row", "cls", "start", "family", *by).orderBy("at"))
    pairs = pairs.withColumn("run", F.col("at") - nth()).withColumn("same_run", F.col("at") - nth("same"))
    same = pairs.where("same").groupBy(*place, "same_run").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named")).groupBy(*place).agg(F.max("n").alias("same"), F.max("named").alias("named"))
    zipped = F.arrays_zip(F.col("pattern").alias("a"), F.col("slots").alias("b"))
    runs = pairs.groupBy(*place, "run").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("alike"), F.array_distinct(F.flatten(F.collect_list(zipped))).alias("s"))
    left, right = F.transform("s", lambda x: x["a"]), F.transform("s", lambda x: x["b"])
    agree = (F.size(F.array_distinct(left)) == F.size("s")) & (F.size(F.array_distinct(right)) == F.size("s"))
    runs = runs.groupBy(*place).agg(F.sum("n").alias("n_matched"), (F.sum("n") == F.sum("alike")).alias("copy"), F.max(F.when(agree, F.col("n"))).alias("agreeing"))
    both = runs.unionByName(same, allowMissingColumns=True)
    both = both.groupBy(*place).agg(F.max("n_matched").alias("n_matched"), F.max("copy").alias("copy"), F.max("agreeing").alias("agreeing"), F.coalesce(F.max("same"), F.lit(0).cast("long")).alias("same"), F.max("named").alias("named"))
    both = both.join(sent(totals), F.col("cls") == F.col("t_cls"))
    enough = F.least(F.col("n_windows"), F.lit(ENOUGH))
    both = both.where(F.greatest("same", "agreeing") >= enough)  # the greatest that is not null
    both = both.withColumn("key", F.coalesce(-F.col("named.said"), "first_key"))
    leaks = both.groupBy("row", "id", "key", "start").agg(F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.min("copy").alias("exact"), F.max("n_items").alias("n_items"))
    leaks = leaks.join(sent(own.select(F.col("key").alias("i_key"), "item")), F.col("key") == F.col("i_key"))
    return leaks.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("start").alias("doc_start"), "n_matched", "n_windows", "exact", "n_items")


def op5(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
