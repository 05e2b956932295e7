"""Substring deduplication by content-defined chunks.

A passage repeats if its bytes stand in two places or more. It is looked at in windows of as many bytes as the shortest
span has characters, at every place. A gear hash rolls over the bytes of a text (each step shifts the last value and adds
a random number of the byte, so a value depends on the last 32 bytes). In each window the least hash, a chunk's end,
stands for the window: equal windows have it at the same place, whatever stands around them. Neighbouring windows with
the same end form a stretch, about two in a window's length, and only stretches are sent, by the digest of the end's
hashed bytes: none but stretches of one such digest can hold equal windows.

Equal stretches form a class whose windows all repeat. Classes of one digest differ somewhere; for them alone the bytes of
one place each are read, and digests of all their windows say which ones are equal. Where more than CROWD classes share a
digest (a common line among ever other words), their windows are grouped by Spark, in turns, else in the task of the digest.

The first place of a window is the least (id, digest of the text, byte). Neighbouring windows with the same first place at
the same distance form a piece, pieces that touch form a span. Spans of fewer than `least_chars` characters are left
alone: short phrases recur by chance. Then the borders of a span leave out a part of a word whose other letters differ.
Equal texts are one text and wholly repeated.

Hash and windows start anew in every text, so equal texts have equal chunks whatever stands next to them.

Where the hashed bytes repeat themselves every PERIOD bytes or faster no chunk ends. Passages like that of the least length or
more are found by comparing bytes with those before them; they repeat themselves if they are a period longer, and others
by the digests of the windows of one period.

Cases: null and empty texts have no chunks; spans never cut a character; places are code points, end exclusive; rows with a null id are compared with all others, each text by itself, under the id null; rows that repeat an id are
judged each by its own text; texts of any length are used whole, but those of fewer than `least_chars` characters hold
no span, also as copies; an empty table gives an empty table; other columns are not kept by `spans`, and all are, whatever their names, by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat_text, small_batches
from tidemark.llm.common import HOT_SHARE, SALTS, drop, hot_keys, salted_join
from tidemark.llm.common import save as written
from tidemark.llm.neardup import U, _powers, mixed

#: Characters of the shortest span that counts as a repeat; every repeat of that length is found.
LEAST_CHARS = 120
#: Bytes up to which a part of a word (ASCII letters, digits, all beyond ASCII) at a span's border is left to the word.
LONG_WORD = 24
#: Bytes of the longest period that is passed over.
PERIOD = 8
#: Bytes that are hashed at a time: what is computed from them fits the processor's cache.
STEP_BYTES = 200_000
#: Classes of one digest up to which one task compares them all, and classes that a worker takes at a time.
CROWD, SOME_CLASSES = 50_000, 2_000
#: Turns in which the windows of larger groups are looked at: so many take their places on disk one after the other.
TURNS = 4
#: Texts whose digests are counted, and rows that are many there: what has more is dealt to many tasks, with the same results.
HINT_TEXTS, HINT_ROWS = 2_000, 20
#: Groups of copies up to which their table is broadcast to the scan of the texts.
MANY_COPIES = 1_000_000

_random = np.random.default_rng(20240602)
_GEAR = _random.integers(0, 2**32, 256, dtype=np.uint32)
_BYTES = _random.integers(0, 2**64, (3, 256), dtype=U)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xF8)]] = True
_NEVER = np.uint32(2**32 - 1)
_HASHED = 32
#: What stands beyond a text's ends; no text has this byte.
_OUTSIDE = np.uint8(0xFF)
#: Eight bytes of 1.
_EIGHT = U(0x0101010101010101)
#: An id that stands for null: it comes after all others.
_NO_ID = 2**63 - 1


def gear(h: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + g[i], modulo 2^32, in five doublings; h holds the g and is changed."""
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def sizes(least_chars: int) -> tuple[int, int]:
    """Bytes that a hash covers and places of a window: together one more than the shortest span."""
    gram = max(1, min(_HASHED, least_chars - 3))
    return gram, max(4, least_chars - gram + 1)


def ends(flat: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks end (exclusive), in order, and for each the first place of the first and of the last window whose least hash it is."""
    none = np.empty(0, np.int64)
    if len(flat) < gram + window - 1:
        return none, none, none
    raw = gear(_GEAR[flat])
    h = raw << np.uint32(_HASHED - gram)
    for k in range(1, min(PERIOD, gram // 2, len(h) - 1) + 1):
        # the lower bits are those of the last bytes; few of them hold the first ones, so bytes are compared too
        same = np.flatnonzero((raw[k:] ^ raw[:-k]) << np.uint32(_HASHED - gram + k) == 0) + k
        same = same[(same >= gram - 1) & (h[same] != _NEVER)]
        for j in range(gram - k):
            same = same[flat[same - j] == flat[same - j - k]]
        h[same] = _NEVER
    low = (h.astype(U) << U(32)) | np.arange(len(h), dtype=U)
    have = 1
    while have < window:  # low[i] is the least of the places i, ..., i + have - 1
        step = min(have, window - have)
        low[:-step] = np.minimum(low[:-step], low[step:])
        have += step
    # windows that lie, with the hashed bytes, in one text
    inside = np.zeros(len(flat) + 1, dtype=np.int32)
    first, last = offsets[:-1] + gram - 1, offsets[1:] - window + 1
    np.add.at(inside, first[last > first], 1)
    np.add.at(inside, last[last > first], -1)
    places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    low = low[places]
    new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]][: len(low)])
    upto = np.r_[new[1:], len(low)][: len(new)] - 1
    good = (low[new] >> U(32)) != U(_NEVER)
    new, upto = new[good], upto[good]
    return (low[new] & U(2**32 - 1)).astype(np.int64) + 1, places[new], places[upto]


def prefix_sums(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For `digests`."""
    return np.r_[U(0), np.cumsum(table[flat] * _powers(1 << max(16, len(flat).bit_length()))[0][: len(flat)])]


def digests(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes from begin to end, whatever stands before them."""
    down = _powers(1 << max(16, (len(sums) - 1).bit_length()))[1]
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U)).view(np.int64)


def beside(flat: np.ndarray, offsets: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a byte of a word stands right before `begin` in the text (2) and at `end` (1), as a sum."""
    before = (begin > offsets[row]) & _WORD[flat[np.maximum(begin - 1, 0)]]
    after = (end < offsets[row + 1]) & _WORD[flat[np.minimum(end, len(flat) - 1)]]
    return (2 * before + after).astype(np.int32)


STRETCHES = "doc_id long, t long, start int, n int, beside int, d long, x long"


def chunked(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs: doc_id, t (digest of the text), text. A row a stretch of windows with one chunk's end: doc_id, t, start (bytes before it), n (its windows), beside (as of the function), d (digest of the end's hashed bytes), x (digest of all its bytes)."""
    gram, window = sizes(least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text", size=STEP_BYTES):
                flat, offsets = flat_text(batch.column("text"))
                end, first, last = ends(flat, offsets, gram, window)
                if not len(end):
                    continue
                row = np.searchsorted(offsets, end - 1, side="right") - 1
                begin, upto, sums = first - gram + 1, last + window, prefix_sums(flat, _BYTES[0])
                columns = (begin - offsets[row]).astype(np.int32), (last - first + 1).astype(np.int32), beside(flat, offsets, row, begin, upto), digests(sums, end - gram, end), digests(sums, begin, upto)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "t")), *map(pa.array, columns)], names=[f.split()[0] for f in STRETCHES.split(", ")])

    return docs.select("doc_id", "t", "text").mapInArrow(run, STRETCHES)


#: Deletes what a write has shuffled as soon as it ends; else that stays until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """As common.save; what is shuffled for the table leaves the disk with it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def done(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more."""
    for table in tables:
        drop(table)


def hint(counts: DataFrame, key: str) -> list:
    """As hot_keys, of few rows."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r[0] for r in counts.where((F.col("n") * HOT_SHARE > total) & (F.col("n") > HINT_ROWS)).select(key).collect()]


def hot_digests(texts: DataFrame, least_chars: int) -> tuple[list, list]:
    """d and x that many of some texts' stretches have."""
    share = max(1, texts.count() // HINT_TEXTS)
    some = save(chunked(texts.where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0), least_chars).select("d", "x"), "chunk-hint")
    found = tuple(hint(some.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c) for c in ("d", "x"))
    done(some)
    return found


def met_again(stretches_: DataFrame, hot_d: list, hot_x: list) -> DataFrame:
    """Stretches whose d stands in several places (or is hot), with lead (first of its class), several (whether the class has others) and other (`beside` of the second one). A class of a hot x has several leads."""
    hot = np.array(hot_d, dtype=np.int64)
    names = [f.split()[0] for f in STRETCHES.split(", ")]
    order = ["d", "x", "doc_id", "t", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: pa.Table, before: tuple | None, last: bool) -> pa.RecordBatch:
            """All rows, but for the last one unless no more follow; before: d and x of the row before them."""
            key = {c: rows.column(c).to_numpy() for c in ("d", "x", "beside")}
            alike = lambda c: key[c][1:] == key[c][:-1]
            known = before or (None, None)
            d, x = (np.r_[before is not None and key[c][0] == v, alike(c)] for c, v in zip(("d", "x"), known, strict=True))
            x &= d
            follows = lambda same: np.r_[same[1:], False]
            taken = d | follows(d) | np.isin(key["d"], hot)
            taken[len(taken) if last else -1 :] = False
            where = pa.array(np.flatnonzero(taken))
            extra = [pa.array(v[taken]) for v in (~x, x | follows(x), np.r_[key["beside"][1:], 0].astype(np.int32))]
            return pa.RecordBatch.from_arrays([*(rows.column(c).take(where).combine_chunks() for c in names), *extra], names=[*names, "lead", "several", "other"])

        before, rest = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if not rows.num_rows:
                continue
            # a row that stands there twice is one place
            same = np.logical_and.reduce([rows.column(c).to_numpy()[1:] == rows.column(c).to_numpy()[:-1] for c in order])
            rows = rows.take(pa.array(np.flatnonzero(np.r_[True, ~same]))) if same.any() else rows
            yield judged(rows, before, last=False)
            if rows.num_rows > 1:
                before = tuple(rows.column(c)[rows.num_rows - 2].as_py() for c in ("d", "x"))
            rest = rows.slice(rows.num_rows - 1).combine_chunks()
        if rest is not None:
            yield judged(rest, before, last=True)

    dealt = F.when(F.col("x").isin(hot_x), F.xxhash64("x", F.pmod("t", F.lit(SALTS)))).when(F.col("d").isin(hot_d), F.col("x")).otherwise(F.col("d"))
    rows = stretches_.repartition(dealt).sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"{STRETCHES}, lead boolean, several boolean, other int")


CLASS = "doc_id long, t long, start int, n int, d long, x long, several boolean, other int"


def with_bytes(leads: DataFrame, texts: DataFrame, least_chars: int) -> DataFrame:
    """leads: CLASS. With the bytes of their windows, and one more on each side."""
    span = sum(sizes(least_chars)) - 1
    names = [f.split()[0] for f in CLASS.split(", ")]
    listed = leads.groupBy("t").agg(F.collect_list(F.struct(*(n for n in names if n != "t"))).alias("leads"))  # some for each chunk of the text
    both = listed.join(texts.select(F.col("t").alias("own_t"), "text").hint("merge"), F.col("t") == F.col("own_t")).select("t", "leads", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text", size=STEP_BYTES):
                flat, offsets = flat_text(batch.column("text"))
                flat = np.r_[_OUTSIDE, flat, _OUTSIDE]
                owner, each = pc.list_parent_indices(batch.column("leads")), pc.list_flatten(batch.column("leads"))
                column = {each.type.field(k).name: each.field(k) for k in range(each.type.num_fields)} | {"t": batch.column("t").take(owner)}
                row, start, n = (x.to_numpy() for x in (owner, column["start"], column["n"]))
                begin = offsets[row] + start  # in flat, one byte before the windows
                size = n + span + 1
                cut = flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
                at = np.cumsum(size)
                cut[(at - size)[start == 0]] = _OUTSIDE
                cut[(at - 1)[begin + size - 1 > offsets[row + 1]]] = _OUTSIDE
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, at].astype(np.int32)), pa.py_buffer(cut)])
                yield pa.RecordBatch.from_arrays([*(column[c] for c in names), data], names=[*names, "bytes"])

    return both.mapInArrow(run, f"{CLASS}, bytes binary")


def all_windows(values: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """values: bytes, as of with_bytes. Of each window the row, its number in the row, its digest, and `beside`."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    flat = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.diff(offsets) - span - 1
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[row] + 1 + number
    return row, number, digests(prefix_sums(flat, _BYTES[1]), begin, begin + span), (2 * _WORD[flat[begin - 1]] + _WORD[flat[begin + span]]).astype(np.int32)


PIECES = "x long, low int, high int, first_doc_id long, first_t long, first_start int, own int, other int"


def shared(classes: DataFrame, least_chars: int) -> DataFrame:
    """classes: CLASS and bytes, those of one d in one task. Windows of each class that repeat, together those with one first place: x, low and high (numbers of the first and last window), first_doc_id, first_t, first_start (of window `low` in the first place), own and other (`beside`, before `low` and after `high`: of the first place, and of one that has it too)."""
    span = sum(sizes(least_chars)) - 1
    order = ["d", "doc_id", "t", "start"]

    def found(rows: pa.Table) -> pa.RecordBatch:
        key = [rows.column(c).to_numpy() for c in order]
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in key])  # a row that stands there twice is one place
        rows = rows.take(pa.array(np.flatnonzero(np.r_[True, ~same]))) if same.any() else rows
        row, number, w, side = all_windows(rows.column("bytes").combine_chunks(), span)
        start, several, second, x, doc_id, t = (rows.column(c).to_numpy() for c in ("start", "several", "other", "x", "doc_id", "t"))
        by = np.argsort(w, kind="stable")  # rows are in order, so a class of windows begins with its first place
        new = np.r_[True, w[by][1:] != w[by][:-1]]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        upto = np.r_[begin[1:], len(by)] - 1
        first, last = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        first[by], last[by] = by[begin][group], by[upto][group]
        taken = np.flatnonzero((row[first] != row[last]) | several[row])
        taken = taken[np.lexsort((number[taken], row[first[taken]], row[taken]))]
        if not len(taken):
            return None
        f, o = first[taken], last[taken]
        own, other = side[f], np.where(row[f] != row[o], side[o], second[row[f]])
        edge = (np.diff(row[taken]) != 0) | (np.diff(row[f]) != 0)
        a, b = np.flatnonzero(np.r_[True, edge]), np.flatnonzero(np.r_[edge, True])
        ends_ = lambda v: (v[a] & 2 | v[b] & 1).astype(np.int32)
        lead = row[f[a]]
        columns = x[row[taken[a]]], number[taken[a]].astype(np.int32), number[taken[b]].astype(np.int32), doc_id[lead], t[lead], (start[lead] + number[f[a]]).astype(np.int32), ends_(own), ends_(other)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[p.split()[0] for p in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < SOME_CLASSES:
                continue
            rows = pa.Table.from_batches(held)
            d = rows.column("d").to_numpy()
            whole = int(np.searchsorted(d, d[-1]))  # rows before the last d, which may go on
            if whole and (out := found(rows.slice(0, whole))) is not None:
                yield out
            held = rows.slice(whole).to_batches()
            n = rows.num_rows - whole
        if n and (out := found(pa.Table.from_batches(held))) is not None:
            yield out

    return classes.repartition("d").sortWithinPartitions(*order).mapInArrow(run, PIECES)


def shared_by_many(classes: DataFrame, least_chars: int) -> DataFrame:
    """As shared, whatever the number of classes of one d: their windows are grouped by Spark."""
    span = sum(sizes(least_chars)) - 1
    names = ["x", "doc_id", "t", "start", "several", "second"]

    def windows(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in (big.slice(k, SOME_CLASSES) for k in range(0, big.num_rows, SOME_CLASSES)):
                    row, number, w, side = all_windows(batch.column("bytes"), span)
                    taken = np.flatnonzero(w.view(U) % U(turns) == turn)
                    own = pa.array(row[taken])
                    columns = [pa.array(v[taken].astype(np.int32)) for v in (number, side)]
                    yield pa.RecordBatch.from_arrays([pa.array(w[taken]), *columns, *(batch.column(c).take(own) for c in names)], names=["w", "number", "side", *names])

        return run

    turns, parts = TURNS, []
    classes = save(classes.withColumnRenamed("other", "second").dropDuplicates(["x", "doc_id", "t", "start"]), "chunk-crowd-classes")
    for turn in range(turns):
        rows = save(classes.mapInArrow(windows(turn), "w long, number int, side int, x long, doc_id long, t long, start int, several boolean, second int"), "chunk-crowd")
        place = F.struct("doc_id", "t", "start", "number", "side")
        groups = save(rows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("second", place).alias("first_second")), "chunk-crowd-groups")
        met = salted_join(rows, groups.drop("n"), "w", hot_keys(groups, "w", "n"), F.col("x"))
        again = (F.col("first.t") != F.col("last.t")) | (F.col("first.start") != F.col("last.start"))
        other = F.when(again, F.col("last.side")).otherwise(F.col("first_second"))
        met = met.where(again | F.col("several")).select("x", "number", "first", other.alias("other"))
        parts.append(save(met, "chunk-crowd-met"))
        done(rows, groups)
    met = reduce(DataFrame.unionByName, parts)
    ends_ = met.groupBy("x", "first.doc_id", "first.t", "first.start").agg(F.min(F.struct("number", F.col("first.number").alias("first_number"), F.col("first.side").alias("side"), "other")).alias("a"), F.max(F.struct("number", F.col("first.side").alias("side"), "other")).alias("b"))
    sides = lambda c: F.col(f"a.{c}").bitwiseAND(2).bitwiseOR(F.col(f"b.{c}").bitwiseAND(1))
    found = ends_.select("x", F.col("a.number").alias("low"), F.col("b.number").alias("high"), F.col("doc_id").alias("first_doc_id"), F.col("t").alias("first_t"), (F.col("start") + F.col("a.first_number")).alias("first_start"), sides("side").alias("own"), sides("other").alias("other"))
    found = save(found, "chunk-crowd-pieces")
    done(classes, *parts)
    return found


LISTED = "begin int, end int, first_doc_id long, first_t long, first_begin int, first boolean, beside int"


def pieces(places: DataFrame, found: DataFrame, texts: DataFrame, least_chars: int) -> DataFrame:
    """places: of met_again; found: PIECES. Pieces of the texts, as of `repeats`."""
    span = sum(sizes(least_chars)) - 1
    counted = save(places.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "chunk-class-sizes")
    each = salted_join(places.select("x", "doc_id", "t", "start"), found, "x", hot_keys(counted, "x", "n"), F.col("t"))
    begin = F.col("start") + F.col("low")
    each = each.select("doc_id", "t", begin.alias("begin"), (F.col("start") + F.col("high") + span).alias("end"), "first_doc_id", "first_t", F.col("first_start").alias("first_begin"), ((F.col("t") == F.col("first_t")) & (begin == F.col("first_start"))).alias("first"), "own", "other")
    each = each.withColumn("beside", F.when(F.col("first"), F.col("other")).otherwise(F.col("own")))
    names = [f.split()[0] for f in LISTED.split(", ")]
    listed = each.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*names)).alias("pieces"))
    both = listed.join(texts.select(F.col("t").alias("own_t"), "text").hint("merge"), F.col("t") == F.col("own_t")).select("doc_id", "t", "pieces", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text", size=STEP_BYTES):
                flat, offsets = flat_text(batch.column("text"))
                letters = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
                owner, part = pc.list_parent_indices(batch.column("pieces")), pc.list_flatten(batch.column("pieces"))
                row = owner.to_numpy()
                begin, end, doc_id, t, first_begin, first, side = (part.field(k).to_numpy(zero_copy_only=False) for k in range(len(names)))
                by = np.lexsort((begin, begin - first_begin, t, row))
                row, begin, end, doc_id, t, first_begin, first, side = (v[by] for v in (row, begin, end, doc_id, t, first_begin, first, side))
                # windows that go on from one stretch to the next one
                shift = begin - first_begin
                edge = (np.diff(row) != 0) | (t[1:] != t[:-1]) | (np.diff(shift) != 0) | (begin[1:] > end[:-1] - span + 1)
                a, b = np.flatnonzero(np.r_[True, edge]), np.flatnonzero(np.r_[edge, True])
                row, low, high = row[a], offsets[row[a]] + begin[a], offsets[row[a]] + end[b]
                low, high, inner_low, inner_high = trimmed(flat, low, high, beside(flat, offsets, row, low, high) | side[a] & 2 | side[b] & 1)
                spots = [pa.array((letters[v] - letters[offsets[row]]).astype(np.int32)) for v in (low, high, inner_low, inner_high)]
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("doc_id", "t")), *spots, pa.array(doc_id[a]), pa.array(first[a])], names=["doc_id", "t", "start", "end", "inner_start", "inner_end", "first_doc_id", "first"])

    return both.mapInArrow(run, "doc_id long, t long, start int, end int, inner_start int, inner_end int, first_doc_id long, first boolean")


def trimmed(flat: np.ndarray, low: np.ndarray, high: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages (many bytes each) without parts of characters at their borders, and these without parts of words too, where a word goes on beyond them (side, as `beside`)."""
    wide = np.arange(LONG_WORD + 1)
    goes_on = np.r_[(flat & 0xC0) == 0x80, False]
    ahead, behind = np.minimum(low[:, None] + wide, len(flat)), np.maximum(high[:, None] - wide, 0)
    low, high = low + np.argmin(goes_on[ahead], axis=1), high - np.argmin(goes_on[behind], axis=1)
    word = np.r_[_WORD[flat], False]
    ahead, behind = np.minimum(low[:, None] + wide, len(flat)), np.maximum(high[:, None] - 1 - wide, 0)
    # no end of the word in reach: 0
    left, right = np.argmin(word[ahead], axis=1), np.argmin(word[behind], axis=1)
    return low, high, np.where(side & 2, low + left, low), np.where(side & 1, high - right, high)


def periodic(flat: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Longest stretches of `least` bytes or more that repeat themselves: begin, end, period (the smallest, PERIOD at most)."""
    out: list[tuple[int, int, int]] = []
    for k in range(1, PERIOD + 1):
        same = np.zeros(len(flat) + 1, dtype=np.int8)
        same[k:-1] = flat[k:] == flat[:-k]
        words = same[: len(same) // 8 * 8].view(U) == _EIGHT
        if least - k >= 24 and not (words[1:] & words[:-1]).any():
            continue
        for j in range(k):  # no text goes on in the next one
            same[np.minimum(offsets[:-1] + j, len(flat))] = 0
        edge = np.diff(np.r_[np.int8(0), same])
        begin, end = np.flatnonzero(edge == 1) - k, np.flatnonzero(edge == -1)
        long = end - begin >= least
        out += [(a, b, k) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True) if not any(x <= a and b <= y for x, y, _ in out)]
    return out


STRETCH = "doc_id long, t long, start int, end int, own boolean, low int, high int, w long"


def stretches(held: DataFrame, least_chars: int) -> DataFrame:
    """Pieces, as of `repeats`, that repeat themselves or another such stretch."""
    names = [f.split()[0] for f in STRETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text", size=STEP_BYTES):
                flat, offsets = flat_text(batch.column("text"))
                found = periodic(flat, offsets, least_chars) if len(flat) >= least_chars else []
                if not found:
                    continue
                letters = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
                windows = [(a, b, b - a >= least_chars + k, a + r) for a, b, k in found for r in range(min(k, b - a - least_chars + 1))]
                begin, end, own, low = (np.array(x) for x in zip(*windows, strict=True))
                row = np.searchsorted(offsets, begin, side="right") - 1
                cut = lambda at: (at < len(flat)) & ((flat[np.minimum(at, len(flat) - 1)] & 0xC0) == 0x80)  # noqa: B023, E731
                place = lambda at, upto=False: pa.array((letters[at] - letters[offsets[row]] - (upto & cut(at))).astype(np.int32))  # noqa: B023, E731
                columns = [place(begin), place(end, True), pa.array(own), place(low), place(low + least_chars, True), pa.array(digests(prefix_sums(flat, _BYTES[2]), low, low + least_chars))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "t")), *columns], names=names)

    rows = save(held.mapInArrow(run, STRETCH), "chunk-stretches")
    spot = F.xxhash64("t", "start")
    classes = rows.groupBy("w").agg(F.min(F.struct("doc_id", "t", "start")).alias("lead"), (F.min(spot) != F.max(spot)).alias("shared"), F.count(F.lit(1)).alias("n"))
    met = salted_join(rows, classes.drop("n"), "w", hot_keys(classes, "w", "n"), F.col("t")).where("own or shared")
    whole = met.groupBy("doc_id", "t", "start", "end", "own").agg(F.min("lead").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"))
    first = (F.col("lead.t") == F.col("t")) & (F.col("lead.start") == F.col("start"))
    start, end = F.when(F.col("own"), F.col("start")).otherwise(F.col("low")), F.when(F.col("own"), F.col("end")).otherwise(F.col("high"))
    return whole.select("doc_id", "t", start.alias("start"), end.alias("end"), start.alias("inner_start"), end.alias("inner_end"), F.col("lead.doc_id").alias("first_doc_id"), first.alias("first"))


def repeats(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every piece that is met twice or more: doc_id, t (digest of the text), start, end, inner_start, inner_end (without parts of words), first_doc_id (the least id that has it), first (whether this is its first place). Null ids are the largest number."""
    long = docs.where(F.length("text") >= least_chars)
    long = long.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    ids = long.select("doc_id", "t", "t2", F.length("text").alias("end"))
    copied = save(ids.groupBy("t", "t2", "end").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").drop("n"), "chunk-copied")
    copies = ids.join(copied.hint("merge"), ["t", "t2", "end"])
    copies = copies.select("doc_id", "t", F.lit(0).alias("start"), "end", F.lit(0).alias("inner_start"), F.col("end").alias("inner_end"), "first_doc_id", (F.col("doc_id") == F.col("first_doc_id")).alias("first"))

    # of equal texts the first stands for all
    many = copied.limit(MANY_COPIES + 1).count() > MANY_COPIES
    side = copied.select(F.col("t").alias("_t"), F.col("t2").alias("_t2"), "first_doc_id")
    held = long.join(side.hint("merge") if many else F.broadcast(side), (F.col("t") == F.col("_t")) & (F.col("t2") == F.col("_t2")), "left")
    held = held.where("first_doc_id is null or doc_id = first_doc_id").select("doc_id", "t", "text")
    held = save(held, "chunk-held") if many else held

    hot_d, hot_x = hot_digests(held, least_chars)
    found = save(met_again(chunked(held, least_chars), hot_d, hot_x), "chunk-met")
    leads = found.where("lead").withColumnRenamed("beside", "own")
    counted = save(leads.groupBy("d").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "chunk-counted")
    leads = salted_join(leads, counted, "d", hot_d, F.col("x"), "left")
    whole = leads.where("classes is null and several").select("x", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), F.col("doc_id").alias("first_doc_id"), F.col("t").alias("first_t"), F.col("start").alias("first_start"), "own", "other")
    cut = save(with_bytes(leads.where("classes > 1"), held, least_chars), "chunk-classes")
    crowds = counted.where(F.col("classes") > CROWD)
    if crowds.limit(1).count():
        crowds = F.broadcast(crowds)  # one row for CROWD of the leads
        parts = [whole, shared(cut.join(crowds, "d", "left_anti"), least_chars), shared_by_many(cut.join(crowds, "d", "left_semi"), least_chars)]
    else:
        parts = [whole, shared(cut, least_chars)]
    shares = reduce(DataFrame.unionByName, parts)
    shares = save(shares.distinct() if hot_x else shares, "chunk-shares")
    done(counted, cut)
    own = save(pieces(found, shares, held, least_chars), "chunk-pieces")
    done(found, shares)
    return own.unionByName(stretches(held, least_chars)).unionByName(copies)


def spans(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Repeated spans of each text: doc_id, t (digest of the text), start, end, n_chunks (pieces), n_first (pieces that have their first place here), first_doc_ids, later (pieces that have it elsewhere)."""
    found = repeats(docs, least_chars).groupBy("doc_id", "t", "start", "end").agg(F.min("inner_start").alias("inner_start"), F.max("inner_end").alias("inner_end"), F.min("first_doc_id").alias("first_doc_id"), F.min("first").alias("first"))
    order = Window.partitionBy("doc_id", "t").orderBy("start", "end")
    gap = (F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    run = found.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = F.nullif("first_doc_id", F.lit(_NO_ID))
    joined = run.groupBy("doc_id", "t", "run").agg(
        F.min("inner_start").alias("start"), F.max("inner_end").alias("end"), (F.max("end") - F.min("start")).alias("whole"), F.count(F.lit(1)).alias("n_chunks"), F.count_if("first").alias("n_first"), F.array_sort(F.collect_set(known)).alias("first_doc_ids"),
        F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct(F.col("inner_start").alias("start"), F.col("inner_end").alias("end"))))).alias("later"),
    )
    return joined.where(F.col("whole") >= least_chars).withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID))).drop("run", "whole")


def without_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with texts from which the pieces of repeated spans are cut, but for their first places."""
    later = spans(docs, least_chars).groupBy("doc_id", "t").agg(F.array_sort(F.flatten(F.collect_list("later"))).alias("later"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_t"))
    both = rows.join(later.hint("merge"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_t") == F.col("t")), "left")
    text = F.col("row.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], text.substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    cut = F.aggregate("later", start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
    kept = F.when(F.size("later") > 0, cut).otherwise(text)
    return both.select(*((kept if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
