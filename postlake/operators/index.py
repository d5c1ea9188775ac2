"""The full-text index as tables, and its incremental maintenance.

`messages`, `postings`, `terms`, `gone` and `sources` are tables of immutable segments, and a manifest names the live
ones (see `snapshots`): an update, a removal or a compaction writes its segments and then takes effect as a whole or
not at all. Each message written gets a number (batch, file and row), and postings know messages by it. A row of the
postings is a token and a run of messages that were read together, with their offsets, weighted frequencies, columns,
lengths and places in two arrays; runs are cut by portions of text and, for a frequent token, into blocks of about BLOCK
messages, so no row grows with the index. Rows lie in the order of tokens in the file of the task that read their messages,
so that a word or a prefix reads the pages whose bounds hold it, and a word of every document is spread over files; ranking
needs no places and doesn't read them. They are made once; nothing is shuffled, or written aside.

A message keeps its normalised texts (NORMS) beside the others, for writers: postings, pairs, what a removal takes back and
a compaction all read these, so a text is normalised once. Readers of the index don't see them.

A row has the greatest frequency and the least length of its documents; `terms`, the dictionary, has the numbers of documents
by token, whole and by columns, exactly: a removal adds rows of negative counts. Frequency
and length bound the score of every document of a row from above under any statistics, so the best k are found by scoring
the most promising stretches first and then only those that can still reach the k-th score. The stretches of different
words are aligned: 2^level units of BLOCK messages from where the portion begins.

`pairs` are postings of adjacent words where either is common in its batch, as `common` notes; phrases are answered from
them instead of whole lists of common words (see `phrases`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import ordinal
from ..functions.text import normalized
from . import phrases
from . import search as scan
from .phrases import Pairs, Part
from .search import B, K1, WEIGHTS, Query, Term, parse
from .snapshots import Manifest, Store, latest

#: Of the tables' form; an index of another form is cleared and built anew.
SCHEMA = 6
#: Ids and tokens that are broadcast at most, and numbers of messages, which are 8 bytes each.
SMALL, NUMBERS = 1 << 16, 1 << 22
#: Documents in a row of postings of a frequent word, about.
BLOCK = 256
#: Bits of a message's number for the file that it was written to, and for the row there; the batch is above them.
FILES, ROWS = 19, 24
#: Stretches that are scored first; those that are pushed to the scan (more are joined).
FIRST, PUSHED = 64, 128


def narrow(rows: DataFrame, n: int) -> DataFrame:
    """Numbers to be joined to messages: broadcast up to NUMBERS, else the side that is hashed, so that no texts are sorted."""
    return F.broadcast(rows) if n <= NUMBERS else rows.hint("shuffle_hash")


def message_key(columns: list[str], store: bool = False) -> Column:
    """The identity of a message in its source before numbering of duplicates.

    Stores with node ids use id, date and size; others hash the listing's fields, empty ones included.
    """
    date = F.coalesce(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    size = F.coalesce(F.col("size"), F.lit(0)).cast("string")
    if store:
        return F.concat(F.lit("nid:"), F.col("nid").cast("string"), F.lit("|"), date, F.lit("|"), size)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")
    return F.concat(F.lit("h:"), F.substring(F.sha1(F.concat_ws("|", text("folder"), text("subject"), text("sender"), date, size, text("to"))), 1, 20))


def numbered(rows: DataFrame, source: str = "source_name", order: str = "nid") -> DataFrame:
    """`key` made unique in its source: the second and later messages of a key get #1, #2 ... in listing order."""
    rows = ordinal(rows, [source, "key0"], order, "_n")
    return rows.withColumn("key", F.when(F.col("_n") > 0, F.concat("key0", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("key0"))).drop("_n")


def plan_changes(listing: DataFrame, indexed: DataFrame, source: str = "source_name", complete: bool = True) -> DataFrame:
    """(source, key, change): added, kept or removed; a listing that failed removes nothing."""
    here, there = listing.select(source, "key", F.lit(True).alias("_here")), indexed.select(source, "key", F.lit(True).alias("_there"))
    change = F.when(F.col("_there").isNull(), "added").when(F.col("_here").isNull(), "removed" if complete else "kept").otherwise("kept")
    return here.join(there, [source, "key"], "full").select(source, "key", change.alias("change"))


POSTINGS = "token string, f double, cols int, places array<bigint>"
#: Bits of a place that hold the position in its column; the column's number is above them.
COLUMN = 32
#: Bytes of text whose tokens are put in order at a time; a longer text is a portion of its own.
PORTION = 16 << 20


def postings(texts: DataFrame, id_column: str = "id", keep: Iterable[str] = (), common: Iterable[str] | None = None) -> DataFrame:
    """(token, id, f, cols, places): one row for each token of a document; and what of the document to keep.

    f is the token's weighted frequency, cols the set of its columns as bits, places its columns and positions. All of a
    document is one row, so its tokens are put in order where it is and nothing is shuffled. With common, the tokens are
    the pairs of adjacent words of a column where either is among these words, and the places are those of second words.
    """
    rows, numbers, kept = _normalized(texts, id_column, keep)
    words = None if common is None else list(common)
    weights = np.array(list(WEIGHTS.values()))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, doc, col, spot, names = _coded(batch, numbers, words)
        order = np.argsort(doc * max(1, len(names)) + code, kind="stable")  # columns and positions stay in order
        code, doc, col, spot = code[order], doc[order], col[order], spot[order]
        starts = _starts(code, doc)
        by_token = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), pa.array(spot))
        f = np.add.reduceat(weights[col], starts) if len(starts) else np.empty(0)
        mask = np.bitwise_or.reduceat(np.int32(1) << col, starts) if len(starts) else np.empty(0, np.int32)
        own = [batch[c].take(pa.array(doc[starts])) for c in kept]
        return pa.RecordBatch.from_arrays([*own, names.take(pa.array(code[starts])).cast(pa.string()), pa.array(f), pa.array(mask), by_token], names=[*kept, "token", "f", "cols", "places"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _portions(batch, numbers):
                yield of(batch.slice(lo, hi - lo))

    schema = ", ".join(f"`{c}` {k}" for c, k in kept.items()) + ", " + POSTINGS
    return rows.mapInArrow(run, schema).select("token", "id", "f", "cols", "places", *keep)


def _normalized(texts: DataFrame, id_column: str, keep: Iterable[str]) -> tuple[DataFrame, list[int], dict[str, str]]:
    """Texts with their normalised columns, the numbers of these, and what else there is with its types."""
    own = norms(texts)
    rows = texts.select(F.col(id_column).alias("id"), *keep, *[c.alias(k) for k, c in own.items()])
    return rows, [NORMS.index(k) for k in own], {f.name: f.dataType.simpleString() for f in rows.schema if f.name not in NORMS}


#: The normalised texts of the indexed columns.
NORMS = [f"_n{i}" for i in range(len(WEIGHTS))]


def norms(texts: DataFrame) -> dict[str, Column]:
    """The normalised texts of the indexed columns that there are; as they are kept, where they are."""
    there = [(k, c) for k, c in zip(NORMS, WEIGHTS, strict=True) if c in texts.columns]
    return {k: F.col(k) if k in texts.columns else F.trim(normalized(F.col(c))) for k, c in there}


def _portions(batch: pa.RecordBatch, numbers: list[int], cuts: Iterable[int] = ()) -> Iterable[tuple[int, int]]:
    """Where portions of a batch begin and end: at PORTION bytes of text, and at these rows."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch[f"_n{i}"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in numbers))
    lo = 0
    for stop in (*cuts, batch.num_rows):
        while lo < stop:
            hi = min(stop, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, side="right"))))
            yield lo, hi
            lo = hi


def _coded(batch: pa.RecordBatch, numbers: list[int], words: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Each token of a batch: its code, row, column and place; and the tokens by code. With words, the pairs that hold one."""
    docs, cols, places, found = [], [], [], []
    for i in numbers:
        lists = pc.split_pattern(batch[f"_n{i}"].cast(pa.large_string()).fill_null(""), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        docs.append(np.repeat(np.arange(batch.num_rows), sizes))
        cols.append(np.full(int(sizes.sum()), i, np.int32))
        places.append(np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + (i << COLUMN))
        found.append(pc.list_flatten(lists))
    coded = pa.chunked_array(found).combine_chunks().dictionary_encode()
    code, doc, col, spot = coded.indices.to_numpy(), np.concatenate(docs), np.concatenate(cols), np.concatenate(places)
    names = coded.dictionary
    if words is not None:
        known = pc.is_in(names, pa.array(words, names.type)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero((doc[1:] == doc[:-1]) & (col[1:] == col[:-1]) & (known[code[1:]] | known[code[:-1]]))
        met, both = np.unique(code[at].astype(np.int64) * len(names) + code[at + 1], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(met // max(1, len(names)))), names.take(pa.array(met % max(1, len(names)))), pa.scalar(" ", names.type))
        code, doc, col, spot = both, doc[at], col[at], spot[at + 1]
    empty = pc.index(names, "").as_py()  # what an empty text is split into
    if empty >= 0:
        some = code != empty
        code, doc, col, spot = code[some], doc[some], col[some], spot[some]
    return code, doc, col, spot, names


def _ordered(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below `most`: one sort of keys with their places behind them, where these fit into 63 bits."""
    bits = max(1, len(keys)).bit_length()
    if most << bits >= 1 << 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & (1 << bits) - 1


def _starts(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])[: len(code)])


ATT = [i for i, c in enumerate(WEIGHTS) if c in ("attachments", "att_names")]
#: The counts of a row of postings: documents, those with the token in each column, and in either column of attachments.
COUNTS = ["n", *[f"c{i}" for i in range(len(WEIGHTS))], "att"]
PACKED = "token string, base bigint, unit int, lo int, hi int, top int, short int, data array<int>, places array<int>"
#: What data has of each document, one list behind the other; bits of a packed place that hold the position.
DATA, PACKED_AT = ("off", "f", "cols", "length", "end"), 28


def packed(stored: DataFrame, block: int = BLOCK, common: Iterable[str] | None = None) -> DataFrame:
    """The rows of `postings`, or with common of `pairs`, of messages as written (num, batch, length and texts).

    base: the number of the portion's first message; lo, hi: the units (of so many messages) that the row is of; data: the
    documents' distances from base, weighted frequencies (whole numbers, as the weights are), columns, lengths, and where
    their places end in places. Few columns and narrow ones: most rows have one document.
    """
    rows, numbers, _ = _normalized(stored, "num", ("length",))
    words = None if common is None else list(common)
    weights = np.array(list(WEIGHTS.values()))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, doc, col, spot, names = _coded(batch, numbers, words)
        order = _ordered(code.astype(np.int64) * batch.num_rows + doc, len(names) * batch.num_rows)  # columns and positions stay in order
        code, doc, col, spot = code[order], doc[order], col[order], spot[order]
        starts = _starts(code, doc)
        some = len(starts) > 0
        over = lambda f, x, at: f.reduceat(x, at) if some else x[:0]
        f, mask = over(np.add, weights[col], starts), over(np.bitwise_or, np.int32(1) << col, starts)
        code, doc, ends = code[starts], doc[starts], np.append(starts[1:], len(code))
        # Units of a row of each token: so many that about `block` documents have it, and a power of two.
        units, df = -(-batch.num_rows // block), np.bincount(code, minlength=len(names))
        wide = 2 ** np.floor(np.log2(np.maximum(1, units * block / np.maximum(1, df)))).astype(np.int64)
        wide = np.where(df <= block, 1 << max(0, units - 1).bit_length(), wide)[code]
        part = doc // block // wide
        cuts = _starts(code, part)
        bounds = np.append(cuts, len(code)).astype(np.int32)
        length = batch["length"].to_numpy(zero_copy_only=False)[doc]
        n, first = np.diff(bounds), starts[cuts] if some else starts
        row = np.repeat(np.arange(len(cuts)), n)
        if len(spot) and int((spot & (1 << COLUMN) - 1).max()) >> PACKED_AT:
            raise ValueError(f"a text of more than {1 << PACKED_AT} words")
        data, at = np.empty(len(DATA) * len(code), np.int32), (np.arange(len(code)) - bounds[:-1][row]) + len(DATA) * bounds[:-1][row].astype(np.int64)
        for k, x in enumerate((doc, f, mask, length, ends - first[row])):
            data[at + k * n[row]] = x
        same = lambda x, kind: pa.array(np.full(len(cuts), x), kind)
        places = (spot >> COLUMN << PACKED_AT) + (spot & (1 << COLUMN) - 1)
        one = {
            "token": names.take(pa.array(code[cuts])).cast(pa.string()), "base": same(batch["id"][0].as_py(), pa.int64()), "unit": same(block, pa.int32()),
            "lo": pa.array((part * wide)[cuts], pa.int32()), "hi": pa.array(np.minimum((part + 1) * wide, units)[cuts], pa.int32()),
            "top": pa.array(over(np.maximum, f, cuts).astype(np.int32)), "short": pa.array(over(np.minimum, length, cuts), pa.int32()),
            "data": pa.ListArray.from_arrays(pa.array(bounds * len(DATA)), pa.array(data)), "places": pa.ListArray.from_arrays(pa.array(np.append(first, len(spot)).astype(np.int32)), pa.array(places, pa.int32())),
        }
        return pa.RecordBatch.from_arrays(list(one.values()), names=list(one))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            num = batch["id"].to_numpy(zero_copy_only=False)
            for lo, hi in _portions(batch, numbers, np.flatnonzero(num[1:] != num[:-1] + 1) + 1):
                yield of(batch.slice(lo, hi - lo))

    return rows.mapInArrow(run, PACKED)


def unpacked(rows: DataFrame) -> DataFrame:
    """(token, batch, base, unit, off, id, f, cols, length, places): one row for each token of a message, which id is the number of."""
    n = F.floor(F.size("data") / len(DATA)).cast("int")
    each = rows.select("token", "base", "unit", "data", "places", n.alias("_n"), F.posexplode(F.slice("data", F.lit(1), n)).alias("_i", "off"))
    of = {c: F.get("data", F.col("_i") + F.col("_n") * k) for k, c in enumerate(DATA)}
    begun = F.when(F.col("_i") == 0, 0).otherwise(F.get("data", F.col("_i") + F.col("_n") * DATA.index("end") - 1))
    place = lambda p: F.shiftleft(F.shiftright(p, PACKED_AT).cast("bigint"), COLUMN) + p.bitwiseAND((1 << PACKED_AT) - 1)
    return each.select(
        "token", F.shiftright("base", FILES + ROWS).alias("batch"), "base", "unit", "off", (F.col("base") + F.col("off")).alias("id"), of["f"].cast("double").alias("f"), of["cols"].alias("cols"),
        of["length"].alias("length"), F.transform(F.slice("places", begun + 1, of["end"] - begun), place).alias("places"),
    )


def length(texts: DataFrame) -> Column:
    """The tokens of all indexed columns, as ranking counts them."""
    # A blank is a byte; the text stands twice, so have it normalised before.
    count = lambda c: F.when(c == "", 0).otherwise(F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1)
    return reduce(lambda a, b: a + b, map(count, norms(texts).values()), F.lit(0))


def _in(place: Column, term: Term) -> Column:
    return F.shiftright(place, COLUMN).isin([i for i, c in enumerate(WEIGHTS) if c in term.columns])


def weighed(places: Column) -> Column:
    """The sum of the weights of places' columns."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS.values()])
    return F.aggregate(places, F.lit(0.0), lambda a, p: a + F.get(weights, F.shiftright(p, COLUMN).cast("int")))


def frequency(term: Term) -> Column:
    """The weighted frequency of a single word in a term's columns; only of some columns its places are read."""
    return F.col("f") if len(term.columns) == len(WEIGHTS) else weighed(F.filter("places", lambda p: _in(p, term)))


def in_columns(term: Term) -> Column:
    return F.col("cols").bitwiseAND(sum(1 << i for i, c in enumerate(WEIGHTS) if c in term.columns)) != 0


def dictionary(rows: DataFrame, batch: int, sign: int = 1) -> DataFrame:
    """The counts of tokens in rows of postings; sign -1: what takes them back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in batches:
            sizes = pc.list_value_length(part["data"]).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            n, data = sizes // len(DATA), pc.list_flatten(part["data"]).to_numpy(zero_copy_only=False)
            starts = np.cumsum(n) - n
            cols = data[np.arange(int(n.sum())) - np.repeat(starts, n) + np.repeat(np.cumsum(sizes) - sizes + DATA.index("cols") * n, n)]
            bits = [np.ones(len(cols), np.int64), *[cols >> i & 1 for i in range(len(WEIGHTS))], (cols & sum(1 << i for i in ATT)) != 0]
            yield pa.RecordBatch.from_arrays([part["token"], *[pa.array(np.add.reduceat(x.astype(np.int64), starts)) for x in bits]], names=["token", *COUNTS])

    return _summed(rows.select("token", "data").mapInArrow(run, COUNTED), batch, sign)


COUNTED = "token string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _summed(counts: DataFrame, batch: int, sign: int) -> DataFrame:
    return counts.groupBy("token").agg(*[(F.sum(c) * sign).alias(c) for c in COUNTS]).withColumn("batch", F.lit(batch).cast("long"))


def counts_of(stored: DataFrame, batch: int, sign: int = 1) -> DataFrame:
    """What `dictionary` gives of the postings of messages as written, from their texts alone: a row a token and portion."""
    rows, numbers, _ = _normalized(stored, "num", ())

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, doc, col, _, names = _coded(batch, numbers, None)
        met = np.unique((code.astype(np.int64) * batch.num_rows + doc) * len(WEIGHTS) + col)  # a token in a column of a message
        pair, col = met // len(WEIGHTS), met % len(WEIGHTS)
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        mask = np.bitwise_or.reduceat(np.int64(1) << col, starts) if len(starts) else met
        code = pair[starts] // max(1, batch.num_rows)
        bits = [np.ones(len(code), np.int64), *[mask >> i & 1 for i in range(len(WEIGHTS))], (mask & sum(1 << i for i in ATT)) != 0]
        each = [np.bincount(code, weights=x, minlength=len(names)).astype(np.int64) for x in bits]
        some = np.flatnonzero(each[0])
        return pa.RecordBatch.from_arrays([names.take(pa.array(some)).cast(pa.string()), *[pa.array(x[some]) for x in each]], names=["token", *COUNTS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _portions(batch, numbers):
                yield of(batch.slice(lo, hi - lo))

    return _summed(rows.mapInArrow(run, COUNTED), batch, sign)


def counted_as(term: Term) -> str | None:
    """The dictionary's column that counts the documents of a single word in a term's columns."""
    if len(term.words) > 1 or term.prefix:
        return None
    ids = [i for i, c in enumerate(WEIGHTS) if c in term.columns]
    return "n" if len(ids) == len(WEIGHTS) else "att" if ids == ATT else f"c{ids[0]}" if len(ids) == 1 else None


def _parts(table: DataFrame, term: Term, pairs: Pairs | None) -> list[list[tuple[Part, DataFrame]]]:
    """The lists that answer a term, by sets of batches; each with the rows of its list."""
    found = []
    for batches, parts in (pairs or Pairs()).covers(term):
        rows = []
        for p in parts:
            lists = pairs.rows if p.paired else table
            lists = lists.where(F.col("batch").isin(batches)) if batches is not None else lists
            rows.append((p, lists.where((F.startswith("token", F.lit(p.token)) if p.begun else F.col("token") == p.token) & in_columns(term))))
        found.append(rows)
    return found


def _later(shift: int) -> Column:
    return F.transform("p", lambda x: x + shift)


def _all_places(parts: list[tuple[Part, DataFrame]], term: Term) -> DataFrame:
    """(id, p): documents where all lists meet, and the places of the phrase's last word."""
    found: DataFrame | None = None
    for p, rows in parts:
        shift = len(term.words) - 1 - p.last
        rows = rows.select("id", (F.col("places") if len(term.columns) == len(WEIGHTS) else F.filter("places", lambda x: _in(x, term))).alias("p"))
        if p.begun:  # several tokens of a document may begin so; a group is bounded by the document
            rows = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"))
        rows = rows.select("id", _later(shift).alias("p")) if shift else rows
        if found is not None:
            rows = rows.withColumnRenamed("p", "q").join(found, "id").select("id", F.array_intersect("p", "q").alias("p")).where(F.size("p") > 0)
        found = rows
    return found


def _union(each: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), each)  # of sets of batches, which share no document


def hits(table: DataFrame, term: Term, pairs: Pairs | None = None) -> DataFrame:
    """(id, p): the documents that have the term in its columns, and the places of its last word."""
    return _union([_all_places(parts, term) for parts in _parts(table, term, pairs)])


def lookup(table: DataFrame, term: Term, pairs: Pairs | None = None) -> DataFrame:
    """Ids of the documents that have the term, from the postings; a single list needs no places."""
    found = []
    for parts in _parts(table, term, pairs):
        begun = parts[0][0].begun
        found.append((parts[0][1] if len(parts) == 1 else _all_places(parts, term)).select("id"))
        found[-1] = found[-1].distinct() if len(parts) == 1 and begun else found[-1]
    return _union(found)


def frequencies(table: DataFrame, term: Term, name: str, pairs: Pairs | None = None) -> DataFrame:
    """(id, name): the weighted frequency of the term in each document that has it."""
    found = []
    for parts in _parts(table, term, pairs):
        if len(parts) == 1 and not parts[0][0].begun:
            found.append(parts[0][1].select("id", frequency(term).alias(name)))
        else:
            found.append(_all_places(parts, term).select("id", weighed(F.col("p")).alias(name)))
    return _union(found)


FILTERED = ("date", "folder", "source_name", "source_path", "att_count")


def ranked(table: DataFrame, messages: DataFrame, query: str | Query, live: bool = False, limit: int = 500, offset: int = 0, order: str = "id", pairs: Pairs | None = None) -> DataFrame:
    """The best messages with `score`, as `search.ranked` gives them, from postings alone; messages need `length`.

    No text is read but that of the rows returned: statistics are scalar subqueries over postings and lengths.
    """
    q = parse(query, live) if isinstance(query, str) else query
    if not q.positive:
        newest = [F.desc_nulls_last("date")] if "date" in messages.columns else []
        return search(table, messages, q, pairs=pairs).withColumn("score", F.lit(0.0)).orderBy(*newest, order).offset(offset).limit(limit)
    there = messages.select("id")
    best, df = messages.select(*dict.fromkeys(["id", order, *[c for c in FILTERED if c in messages.columns], "length"])).where(scan.filters(q, messages.columns)), []
    for i, term in enumerate(q.positive):
        found = frequencies(table, term, f"tf{i}", pairs).join(there, "id", "left_semi")
        df.append(found.agg(F.count("*").alias("n")).scalar())
        best = best.join(found, "id")
    for term in q.negative:
        best = best.join(lookup(table, term, pairs), "id", "left_anti")
    total = messages.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean")).alias("t")).scalar()
    best = best.withColumns({"_t": total} | {f"_df{i}": n for i, n in enumerate(df)})
    score = scan.bm25([F.col(f"tf{i}") for i in range(len(df))], [F.col(f"_df{i}") for i in range(len(df))], F.col("length"), F.col("_t.n"), F.col("_t.mean"))
    return _shown(best.withColumn("score", score), messages, limit, offset, order)


def _shown(best: DataFrame, messages: DataFrame, limit: int, offset: int, order: str) -> DataFrame:
    """The messages of the best scores; best has id, order and score."""
    best = best.select(*dict.fromkeys(["id", order, "score"])).orderBy("score", order).offset(offset).limit(limit).select("id", "score")
    return messages.join(F.broadcast(best), "id").orderBy("score", order)  # at most `limit` ids


def _named(found: DataFrame) -> DataFrame:
    """Messages under their own ids again."""
    return found.drop("id").withColumnRenamed("_id", "id")


def search(table: DataFrame, messages: DataFrame, query: str | Query, live: bool = False, pairs: Pairs | None = None) -> DataFrame:
    """Messages that match by postings: semi joins for terms, an anti join for excluded ones."""
    q = parse(query, live) if isinstance(query, str) else query
    rows = messages.where(scan.filters(q, messages.columns))
    for term in q.positive:
        rows = rows.join(lookup(table, term, pairs), "id", "left_semi")
    for term in q.negative:
        rows = rows.join(lookup(table, term, pairs), "id", "left_anti")
    return rows


class Index:
    """The tables under a folder. One writer at a time."""

    TABLES = ("messages", "postings", "pairs", "common", "terms", "gone", "sources")

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, least: int = phrases.LEAST):
        self.spark, self.path, self.block, self.least = spark, path.rstrip("/"), block, least
        self.store = Store(spark, path)
        m = self.store.current()
        if m.version and m.totals.get("form") != SCHEMA:
            self.clear()

    # What readers see

    def _alive(self, name: str, m: Manifest, within: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame | None:
        """The rows of a table whose message no later batch has removed; of postings a row a message (within: which of their rows)."""
        rows, gone = self.store.read(name, m), self.store.read("gone", m)
        key = "num" if name == "messages" else "id"
        rows = unpacked(within(rows)) if rows is not None and key == "id" else rows
        if rows is None or gone is None:
            return rows
        gone = gone.select(F.col("num").alias(key))
        return rows.join(narrow(gone, m.totals.get("gone", 0)), key, "left_anti")

    def messages(self) -> DataFrame | None:
        """All messages that are in the index now."""
        rows = self._alive("messages", self.store.current())
        return rows.drop("batch", "num", *NORMS) if rows is not None else None

    def postings(self) -> DataFrame | None:
        """The postings of these messages."""
        return self._alive("postings", self.store.current())

    def occurrences(self, column: str) -> DataFrame:
        """(token, n): how often each word is in a column of these messages; without removals, rows are counted as they lie."""
        m, i = self.store.current(), list(WEIGHTS).index(column)
        if self.store.read("gone", m) is not None:
            rows, at = self.postings(), COLUMN
        else:
            rows, at = self.store.read("postings", m), PACKED_AT
        counted = rows.select("token", F.size(F.filter("places", lambda p: F.shiftright(p, at) == i)).alias("n"))
        return counted.groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")

    def _numbered(self, m: Manifest) -> DataFrame:
        """The messages under their numbers, as postings know them."""
        return self._alive("messages", m).drop("batch", *NORMS).withColumnRenamed("id", "_id").withColumnRenamed("num", "id")

    def sources(self) -> DataFrame | None:
        """The state of each source at its last update."""
        rows = self.store.read("sources", self.store.current())
        if rows is None:
            return None
        return latest(rows, ["source_name"]).where("not removed").select("source_name", "size", "mtime", "complete", "messages").orderBy(F.lower("source_name"))

    def message(self, id: str) -> DataFrame:
        return self.messages().where(F.col("id") == id)

    def is_current(self, source: str, size: int, mtime: float) -> bool:
        rows = self.sources()
        if rows is None:
            return False
        same = (F.col("source_name") == source) & F.col("complete") & (F.col("size") == size) & (F.abs(F.col("mtime") - mtime) < 1)
        return bool(rows.where(same).take(1))

    def statistics(self) -> DataFrame:
        rows = self.messages()
        atts = F.coalesce(F.sum("att_count"), F.lit(0)) if "att_count" in rows.columns else F.lit(0)
        return rows.agg(F.count_distinct("source_name").alias("sources"), F.count("*").alias("messages"), atts.alias("attachments"))

    def terms(self, prefix: str = "") -> DataFrame:
        """(token, df) of the words that begin so, from the dictionary alone."""
        rows = self.store.read("terms", self.store.current())
        rows = rows.where(F.startswith("token", F.lit(prefix))) if prefix else rows
        return rows.groupBy("token").agg(F.sum("n").alias("df")).where("df > 0")

    def _pairs(self, q: Query, m: Manifest) -> Pairs | None:
        """What a query's phrases are answered from; None without a phrase."""
        terms = [t for t in (*q.positive, *q.negative) if len(t.words) > 1]
        noted = self.store.read("common", m) if terms else None
        if noted is None:
            return None
        words = sorted({w for t in terms for w in t.words})
        pairs = Pairs(self._alive("pairs", m))
        for r in noted.where(F.col("token").isNull() | F.col("token").isin(words)).collect():  # a row a batch and common word of the query
            pairs.common.setdefault(r["batch"], set()).update([r["token"]] if r["token"] is not None else [])
        if any(len(parts) > 1 for t in terms for _, parts in pairs.covers(t)):
            counts = self.store.read("terms", m).where(F.col("token").isin(words)).groupBy("token").agg(F.sum("n").alias("df"))
            pairs.df = {r["token"]: r["df"] for r in counts.collect()}  # a row a word of the query
        return pairs

    def search(self, query: str, live: bool = False) -> DataFrame:
        q, m = parse(query, live), self.store.current()
        return _named(search(self._alive("postings", m), self._numbered(m), q, live, self._pairs(q, m)))

    def ranked(self, query: str, live: bool = False, limit: int = 500, offset: int = 0, order: str = "id") -> DataFrame:
        """The best messages with `score`; queries of single words read the blocks that can hold them, others whole lists."""
        q, m = parse(query, live), self.store.current()
        messages, order = self._numbered(m), "_id" if order == "id" else order
        if not q.positive or not all(map(counted_as, q.positive)) or not m.totals.get("messages"):
            return _named(ranked(self._alive("postings", m), messages, q, live, limit, offset, order, self._pairs(q, m)))
        best = Blocks(self, m, q).best(limit + offset, order)
        return _named(_shown(best, messages, limit, offset, order))

    def resolve(self, hits: DataFrame, listing: DataFrame) -> DataFrame:
        """The listing rows of hits as they are now, by source and key; hits whose message is gone are left out."""
        keyed = numbered(listing.withColumn("key0", message_key(listing.columns))).drop("key0")
        return keyed.join(hits.select("source_name", "key"), ["source_name", "key"], "left_semi")

    # What writers do

    def _begin(self) -> Manifest:
        self.store.vacuum()
        m = self.store.current()
        m.batch += 1
        m.totals["form"] = SCHEMA
        return m

    def _write_messages(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """Messages with their numbers, which are those of a file in order."""
        at = F.monotonically_increasing_id()
        file, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
        num = F.lit(m.batch << FILES + ROWS).cast("long") + F.shiftleft(file, ROWS) + row
        fits = (file < 1 << FILES) & (row < 1 << ROWS) & F.lit(m.batch < 1 << 63 - FILES - ROWS)
        num = F.when(fits, num).otherwise(F.raise_error(F.lit("too many messages in a file, or files or batches, for their numbers")).cast("long"))
        return self.store.write(rows.withColumns({"batch": F.lit(m.batch).cast("long"), "num": num}), "messages", m)

    def _write_lists(self, rows: DataFrame, table: str, m: Manifest) -> DataFrame:
        """Rows of postings in the order of tokens, in a file where their messages were read: nothing is shuffled."""
        return self.store.write(rows.sortWithinPartitions("token", "base", "lo"), table, m)

    def _write_terms(self, stored: DataFrame, m: Manifest, n: int) -> None:
        """The postings of messages just written, and their dictionary."""
        found = self._write_lists(packed(stored, self.block), "postings", m)
        terms = self.store.write(dictionary(found, m.batch).repartitionByRange("token").sortWithinPartitions("token"), "terms", m)
        self._write_pairs(stored, terms, m, n)

    def _write_pairs(self, stored: DataFrame, terms: DataFrame, m: Manifest, n: int) -> None:
        """The common words of messages just written, and the postings of their pairs."""
        most = terms.groupBy("token").agg(F.sum("n").alias("df")).where(F.col("df") >= max(self.least, n * phrases.SHARE)).orderBy(F.desc("df"), "token").limit(phrases.COMMON)
        common = [r["token"] for r in most.collect()]
        self.store.write(self.spark.createDataFrame([(m.batch, w) for w in (None, *common)], "batch long, token string").coalesce(1), "common", m)
        if common:
            self._write_lists(packed(stored, self.block, common), "pairs", m)

    def _write_gone(self, removed: DataFrame, m: Manifest) -> int:
        """Take messages (rows of `messages` with their texts) out of the index; how many."""
        gone = self.store.write(removed.select("id", "num", "length", F.lit(m.batch).cast("long").alias("batch")), "gone", m)
        n, words = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.store.write(counts_of(removed, m.batch, -1).repartitionByRange("token").sortWithinPartitions("token"), "terms", m)
        for k, v in (("gone", n), ("messages", -n), ("words", -words)):
            m.totals[k] = m.totals.get(k, 0) + v
        return n

    def update(self, listing: DataFrame, fingerprints: DataFrame, force: bool = False, complete: bool = True, texts: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Bring the sources in the listing up to date; only messages whose key is unknown are read, indexed and written.

        listing: source_name, nid (unique in its source) and the listing's fields, which give the keys. Rows whose
        `unread` is true stand for messages that couldn't be read this time: they aren't indexed, and nothing is removed
        from their source. texts: the indexed texts (and whatever else is stored) of the listing rows it is given, under
        the same source_name and nid; without it the listing itself holds them. fingerprints: source_name, size, mtime.
        """
        m = self._begin()
        failed = None
        if "unread" in listing.columns:
            failed = listing.where("unread").select("source_name").distinct().withColumn("_failed", F.lit(True))
            listing = listing.where("not coalesce(unread, false)").drop("unread")
        keys = listing.select("source_name", "nid", message_key(listing.columns).alias("key0")).persist()
        keyed = numbered(keys).select("source_name", "nid", "key", F.lit(True).alias("_here"))
        names = fingerprints.select("source_name").distinct()
        old = self._alive("messages", m)
        none = keyed.limit(0).select("source_name", "key", F.lit(0).cast("long").alias("num"))
        there = none if old is None else old.join(names, "source_name", "left_semi").select("source_name", "key", "num")
        plan = keyed.join(there.withColumn("_there", F.lit(True)), ["source_name", "key"], "full")
        plan = plan.join(failed, "source_name", "left") if failed is not None else plan.withColumn("_failed", F.lit(None).cast("boolean"))
        whole = F.lit(complete) & F.col("_failed").isNull()
        change = F.when(F.col("_there").isNull(), "added").when(F.col("_here").isNull(), F.when(whole, "removed").otherwise("kept")).otherwise(F.lit("renewed" if force else "kept"))
        plan = plan.select("source_name", "nid", "key", "num", change.alias("change")).persist()
        totals = {r["change"]: r["n"] for r in plan.groupBy("change").agg(F.count("*").alias("n")).collect()}
        out, into = plan.where("change in ('removed', 'renewed')"), plan.where("change in ('added', 'renewed')")
        renewed = totals.get("renewed", 0)
        if totals.get("removed") or renewed:
            self._write_gone(old.join(narrow(out.select("num"), totals.get("removed", 0) + renewed), "num", "left_semi"), m)
        if totals.get("added") or renewed:
            keyed = into.select("source_name", "nid", "key")
            keyed = keyed if totals.get("added", 0) + renewed <= SMALL else keyed.hint("shuffle_hash")  # else Spark would sort the texts
            new = listing.drop("key").join(keyed, ["source_name", "nid"])
            new = new.withColumn("id", F.md5(F.concat_ws("\x00", "source_name", "key")))
            if texts is not None:
                new = new.select("source_name", "nid", "key", "id", *[c for c in ("path", "offset", "size", "kind", "flag_read", "folder") if c in new.columns])
                new = texts(new).join(new.select("source_name", "nid", "key", "id"), ["source_name", "nid"])
            new = new.withColumns(norms(new))
            stored = self._write_messages(new.withColumn("length", length(new)), m)
            n, words = stored.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            self._write_terms(stored, m, n)
            for k, v in (("messages", n), ("words", words)):
                m.totals[k] = m.totals.get(k, 0) + v
        counts = plan.where("change != 'removed'").groupBy("source_name").agg(F.count("*").alias("messages"))
        done = fingerprints.join(counts, "source_name", "left")
        done = done.join(failed, "source_name", "left") if failed is not None else done.withColumn("_failed", F.lit(None).cast("boolean"))
        self.store.write(_states(done.select("source_name", "size", F.col("mtime").cast("double").alias("mtime"), whole.alias("complete"), F.coalesce("messages", F.lit(0)).cast("long").alias("messages"), F.lit(False).alias("removed")), m), "sources", m)
        self.store.commit(m)
        plan.unpersist()
        keys.unpersist()
        return {"added": totals.get("added", 0) + renewed, "kept": totals.get("kept", 0), "removed": totals.get("removed", 0) + renewed}

    def remove(self, source: str) -> int:
        """Take a source and all its messages out of the index."""
        m = self._begin()
        rows = self._alive("messages", m)
        if rows is None:
            return 0
        n = self._write_gone(rows.where(F.col("source_name") == source), m)
        state = self.spark.createDataFrame([(source, 0, 0.0, True, 0, True)], "source_name string, size long, mtime double, complete boolean, messages long, removed boolean")
        self.store.write(_states(state, m), "sources", m)
        self.store.commit(m)
        return n

    def prune(self, present: DataFrame) -> list[str]:
        """Remove sources that are not among those present; their names."""
        rows = self.sources()
        gone = [] if rows is None else [r["source_name"] for r in rows.select("source_name").join(present, "source_name", "left_anti").collect()]
        for name in gone:
            self.remove(name)
        return gone

    def clear(self) -> None:
        """An empty index; its batches go on."""
        m = self.store.current()
        if m.version:
            self.store.commit(Manifest(m.version, m.batch, totals={"form": SCHEMA}))
            self.store.vacuum(1)

    def optimize(self) -> None:
        """Every table as one segment of what is there, in the order of tokens where it has any."""
        m = self._begin()
        rows = self._alive("messages", m)
        if rows is None:
            return
        new = Manifest(m.version, m.batch, totals={"form": SCHEMA})
        stored = self._write_messages(rows, new)
        n, words = stored.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        new.totals |= {"messages": n, "words": words}
        if self.store.read("postings", m) is not None:
            self._write_terms(stored, new, n)
        states = latest(self.store.read("sources", m), ["source_name"]).where("not removed").drop("batch")
        self.store.write(_states(states, m), "sources", new)
        self.store.commit(new)


def _states(rows: DataFrame, m: Manifest) -> DataFrame:
    return rows.select("source_name", "size", "mtime", "complete", "messages", "removed", F.lit(m.batch).cast("long").alias("batch"))


class Blocks:
    """The best documents of a query of single words, by the bounds of the postings' rows."""

    def __init__(self, index: Index, m: Manifest, q: Query):
        self.index, self.m, self.q = index, m, q
        self.n, self.mean = m.totals["messages"], m.totals["words"] / max(1, m.totals["messages"])
        words = [t.words[0] for t in q.positive]
        rows = index.store.read("terms", m).where(F.col("token").isin(words))
        sums = {r["token"]: r for r in rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS]).collect()}  # a row a word
        self.df = [sums[w][counted_as(t)] if w in sums else 0 for w, t in zip(words, q.positive, strict=True)]
        self.blocks = index.store.read("postings", m)

    def _idf(self, df: int) -> float:
        idf = math.log((self.n - df + 0.5) / (df + 0.5))
        return idf if idf > 0 else 1e-6

    def ranges(self) -> DataFrame:
        """(base, range, bound): units of messages that may hold all words, and no score exceeds its bound."""
        found: DataFrame | None = None
        for i, t in enumerate(self.q.positive):
            f, short = F.col("top"), F.col("short")
            bound = F.lit(self._idf(self.df[i])) * f * (K1 + 1) / (f + K1 * (1 - B + B * short / self.mean))
            rows = self.blocks.where(F.col("token") == t.words[0]).select("base", bound.alias(f"b{i}"), F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("range"))
            found = rows if found is None else found.join(rows, ["base", "range"])
        return found.select("base", "range", reduce(lambda a, b: a + b, [F.col(f"b{i}") for i in range(len(self.q.positive))]).alias("bound"))

    def scored(self, within: Callable[[str], DataFrame], order: str) -> DataFrame:
        """(id, order, score) of the documents within these ranges that match the whole query; within gives a word's postings."""
        best: DataFrame | None = None
        for i, t in enumerate(self.q.positive):
            rows = within(t.words[0]).where(in_columns(t)).select("id", frequency(t).alias(f"tf{i}"), *([] if i else ["length"]))
            best = rows if best is None else best.join(rows, "id")
        for t in self.q.negative:
            best = best.join(lookup(self.index._alive("postings", self.m), t), "id", "left_anti")
        count = range(len(self.q.positive))
        score = scan.bm25([F.col(f"tf{i}") for i in count], [F.lit(d) for d in self.df], F.col("length"), F.lit(self.n), F.lit(self.mean))
        best = best.select("id", score.alias("score"))
        if order != "id" or self.q.folder or self.q.source or self.q.after or self.q.before or self.q.has_att is not None:
            messages = self.index._numbered(self.m)
            columns = dict.fromkeys(["id", order, *[c for c in FILTERED if c in messages.columns]])
            best = best.join(messages.where(scan.filters(self.q, messages.columns)).select(*columns), "id")
        return best.select(*dict.fromkeys(["id", order, "score"]))

    def _postings(self, word: str, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        rows = self.index._alive("postings", self.m, lambda rows: of(rows.where(F.col("token") == word)))
        return rows.withColumn("range", F.floor(F.col("off") / F.col("unit")).cast("int"))

    def _pushed(self, ranges: list) -> Callable[[str], DataFrame]:
        """Postings in these ranges, by tests that the scan can use; neighbours are one."""
        spans: dict[int, list[list[int]]] = {}
        for base, r in sorted((x["base"], x["range"]) for x in ranges):
            mine = spans.setdefault(base, [])
            if mine and mine[-1][1] == r:
                mine[-1][1] = r + 1
            else:
                mine.append([r, r + 1])
        either = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
        every = [(base, lo, hi) for base, each in spans.items() for lo, hi in each]
        rows = either([(F.col("base") == base) & (F.col("lo") < hi) & (F.col("hi") > lo) for base, lo, hi in every])
        docs = either([(F.col("base") == base) & (F.col("range") >= lo) & (F.col("range") < hi) for base, lo, hi in every])
        return lambda word: self._postings(word, lambda table: table.where(rows)).where(docs)

    def _joined(self, ranges: DataFrame, n: int) -> Callable[[str], DataFrame]:
        ranges = ranges.select("base", "range")
        ranges = F.broadcast(ranges) if n <= SMALL else ranges
        return lambda word: self._postings(word).join(ranges, ["base", "range"], "left_semi")

    def kept(self, k: int) -> tuple[DataFrame, int, int]:
        """The ranges that can hold one of the best k, how many they are, and how many there are at all."""
        ranges = self.ranges().persist()
        total = ranges.count()
        if total <= FIRST:
            return ranges, total, total
        first = ranges.orderBy(F.desc("bound")).limit(FIRST).collect()
        # The k-th of the scores in the most promising ranges: k numbers at most.
        scores = [r["score"] for r in self.scored(self._pushed(first), "id").orderBy("score").limit(k).select("score").collect()]
        if len(scores) < k:
            return ranges, total, total
        kept = ranges.where(F.col("bound") >= -scores[-1] * (1 - 1e-9))
        return kept, kept.count(), total

    def best(self, k: int, order: str) -> DataFrame:
        """(id, order, score) of documents with the best k among them."""
        if self.blocks is None or not all(self.df):
            return self.scored(lambda word: self._postings(word).limit(0), order)
        kept, n, _ = self.kept(k)
        return self.scored(self._pushed(kept.collect()) if n <= PUSHED else self._joined(kept, n), order)
