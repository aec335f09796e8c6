"""Exports of any size as documents: files, entries of ZIP archives, and elements of long JSON lists.

Files are listed by Spark and read by tasks through Arrow's file systems. A file of lines, or of one
JSON list (bare or under "conversations"), is cut into slices that are read side by side. A slice of
a list can't know alone whether it begins inside a text and how deep: each is first scanned under
both assumptions, a fold over a file's slices gives the true ones, and then each slice hands out the
elements that begin in it. An entry of an archive is one stream. Elements longer than ``LONGEST`` come
as several documents, each with a part of its list of messages and all else whole, in the order of
``part``. Memory is bounded by a slice's scan buffer and an element, or by a document's part.

States: 'ok'; 'invalid' (an archive that can't be opened), 'encrypted', 'not_json' (other entries and files).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE, LONGEST, CHUNK = 64 << 20, 16 << 20, 4 << 20

ROW = "path string, part bigint, payload string, state string"
#: A text in quotes, as a whole; a quote alone is one whose end isn't there yet.
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|"|[\[\]{},]', re.DOTALL)
_REST_OF_TEXT = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_WRAPPED = re.compile(rb'\s*\{\s*"conversations"\s*:\s*\[')
#: Names under which a document keeps its messages.
_LISTS = {b'"messages"', b'"chat_messages"', b'"turns"', b'"chunks"', b'"responses"', b'"mapping"'}


def _open(path: str):
    """A seekable file of any store that Arrow knows."""
    from pyarrow import fs

    if re.match("file:|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    scheme, rest = path.split("://", 1)
    store, at = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return store.open_input_file(at)


def tokens(f, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place, token) of brackets, commas and whole texts (long ones as a quote) from a place outside any text; what begins before ``stop`` counts."""
    f.seek(start)
    held, at = b"", start
    while True:
        more = f.read(CHUNK)
        data, used = held + more, 0
        for m in _TOKEN.finditer(data):
            x = m[0]
            if x == b'"':
                break
            if stop is not None and at + m.start() >= stop:
                return
            yield at + m.start(), x if len(x) < 100 else b'"'
            used = m.end()
        else:
            used = len(data)
        if not more:
            return
        held, at = data[used:], at + used


def elements(f, start: int, depth: int, level: int, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """(begin, end) of the lists and objects that begin at a level before ``stop``; ``depth`` is the level at ``start``."""
    begin = None
    for at, x in tokens(f, start):
        if x in b"[{":
            if depth == level:
                if stop is not None and at >= stop:
                    return
                begin = at
            depth += 1
        elif x in b"]}":
            depth -= 1
            if depth == level and begin is not None:
                yield begin, at + 1
                begin = None
        if stop is not None and at >= stop and begin is None:
            return


def _between(f, a: int, b: int) -> bytes:
    f.seek(a)
    return f.read(b - a)


def parts(f, a: int, b: int, longest: int) -> Iterator[bytes]:
    """A document in pieces of about ``longest`` bytes: its largest list of messages is cut, all else is in each."""
    if b - a <= longest:
        yield _between(f, a, b)
        return
    stack, name, text, found = [], b"", b"", (0, 0, 0)
    for at, x in tokens(f, a, b):
        if x in b"[{":
            stack.append((at, text))
        elif x in b"]}":
            begin, name = stack.pop()
            if name in _LISTS and at - begin > found[0]:
                found = (at - begin, begin, at)
        text = x if x[:1] == b'"' else b""
    size, begin, end = found
    if size < longest // 2:
        yield _between(f, a, b)
        return
    head, tail = _between(f, a, begin + 1), _between(f, end, b)
    cuts, deep = [], 0
    for at, x in tokens(f, begin + 1, end):
        deep += (x in b"[{") - (x in b"]}")
        if x == b"," and not deep:
            cuts.append(at)
    first = begin + 1
    for this, following in zip([*cuts, end], [*cuts[1:], end, end], strict=False):
        if following - first > longest or this == end:
            yield head + _between(f, first, this) + tail
            first = this + 1


def _rows(path: str, pieces: Iterator[bytes]) -> Iterator[tuple]:
    for k, raw in enumerate(pieces):
        yield path, k, raw.decode("utf-8", "replace"), "ok"


def _level(head: bytes) -> int:
    """How deep the documents of a JSON text lie: 1 in a list, 2 in a list of conversations, else 0."""
    return 1 if head.lstrip()[:1] == b"[" else 2 if _WRAPPED.match(head) else 0


def _lines(f, path: str, start: int, stop: int | None) -> Iterator[tuple]:
    """Lines that begin from ``start`` on and before ``stop``."""
    f = io.BufferedReader(f, CHUNK) if isinstance(f, pa.NativeFile) else f
    at = start
    if start:  # a line that began before is the slice's before
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    while (stop is None or at < stop) and (line := f.readline()):
        if line.strip():
            yield path, 0, line.decode("utf-8", "replace"), "ok"
        at += len(line)


def _whole(f, path: str, size: int, longest: int) -> Iterator[tuple]:
    """All documents of a JSON text that is one stream."""
    f.seek(0)
    level = _level(f.read(4096))
    spans = list(elements(f, 0, 0, level))
    if level == 0 and len(spans) < 2:
        yield from _rows(path, parts(f, 0, size, longest))
    else:  # values one after another are documents of their own, too
        for a, b in spans:
            yield from _rows(f"{path}#{a}", parts(f, a, b, longest))


def _map(df: DataFrame, each: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that a function gives for each row."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                for out in each(*row):
                    held.append(out)
                    size += sum(len(x) for x in out if isinstance(x, str))
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _begin(f, at: int) -> int:
    """A slice begins at the next place that no backslash can reach over."""
    while at:
        f.seek(at - 1)
        if f.read(1) != b"\\":
            return at
        at += 1
    return at


def scanned(path: str, level: int, k: int, start: int, stop: int) -> Iterator[tuple]:
    """What a slice does to the state: for a begin outside and inside a text, whether it ends inside one and by how much the depth changes."""
    with _open(path) as f:
        a, b = _begin(f, start), _begin(f, min(stop, f.size()))
        data = _between(f, a, b)
    out = []
    for inside in (False, True):
        begin, depth, ends = 0, 0, False
        if inside:
            m = _REST_OF_TEXT.match(data)
            begin, ends = (m.end(), False) if m else (len(data), True)
        for m in _TOKEN.finditer(data, begin):
            x = m[0]
            if x == b'"':
                ends = True
                break
            depth += (x in b"[{") - (x in b"]}")
        out += [int(ends), depth]
    yield path, level, k, a, b, *out


def _sliced(path: str, level: int, start: int, stop: int, inside: int, depth: int, longest: int) -> Iterator[tuple]:
    with _open(path) as f:
        if inside:
            rest, at = b"", start
            while not (m := _REST_OF_TEXT.match(rest)):
                f.seek(start + len(rest))
                more = f.read(CHUNK)
                if not more:
                    return
                rest += more
            at = start + m.end()
        else:
            at = start
        if at >= stop:
            return
        spans = elements(f, at, depth, level, stop)
        with _open(path) as g:  # spans come while the other is read on
            for a, b in spans:
                yield from _rows(f"{path}#{a}", parts(g, a, b, longest))


def _entries(path: str) -> Iterator[tuple]:
    try:
        with _open(path) as f, zipfile.ZipFile(f) as z:
            for x in z.infolist():
                if not x.is_dir():
                    yield path, x.filename, "encrypted" if x.flag_bits & 1 else "ok" if re.search(r"\.(jsonl?|ndjson)$", x.filename, re.I) else "not_json"
    except (zipfile.BadZipFile, OSError, pa.ArrowInvalid):
        yield path, None, "invalid"


def _entry(path: str, name: str | None, state: str, longest: int) -> Iterator[tuple]:
    at = path if name is None else f"{path}!{name}"
    if state != "ok":
        yield at, 0, None, state
        return
    with _open(path) as f, zipfile.ZipFile(f) as z:
        if re.search(r"\.(jsonl|ndjson)$", name, re.I):
            with z.open(name) as g:
                yield from _lines(g, at, 0, None)
            return
        size = z.getinfo(name).file_size
        with z.open(name) as g:
            level = _level(g.read(4096))
        if level == 0:
            with z.open(name) as g:
                yield from _rows(at, parts(io.BytesIO(g.read()) if size <= longest else g, 0, size, longest))
            return
        with z.open(name) as g, z.open(name) as h:  # one finds the elements, the other reads them, both forward
            for a, b in elements(g, 0, 0, level):
                h.seek(a)
                yield from _rows(f"{at}#{a}", parts(io.BytesIO(h.read(b - a)), 0, b - a, longest))


def _kind(path: str) -> Iterator[tuple]:
    with _open(path) as f:
        yield path, int(f.size()), _level(f.read(4096))


def read(spark: SparkSession, path: str, slice_bytes: int = SLICE, longest: int = LONGEST) -> DataFrame:
    """(path, part, payload, state) of all documents below a folder; an element's path ends with its place, '#' and bytes, an entry's is after '!'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # metadata alone
    low = F.lower("path")
    lines, json, zips = low.rlike(r"\.(jsonl|ndjson)$"), low.endswith(".json"), low.endswith(".zip")
    begin = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / slice_bytes) - 1, F.lit(0)).cast("int")))
    cut = lambda df, *c: df.select("path", *c, begin.alias("k")).withColumns({"start": F.col("k").cast("long") * slice_bytes, "stop": (F.col("k").cast("long") + 1) * slice_bytes})

    def some_lines(at: str, start: int, stop: int) -> Iterator[tuple]:
        with _open(at) as f:
            yield from _lines(f, at, start, stop)

    def whole(at: str, size: int) -> Iterator[tuple]:
        with _open(at) as f:
            yield from _whole(f, at, size, longest)

    by_line = _map(cut(files.where(lines)).select("path", "start", "stop").repartition("path", "start"), some_lines, ROW)
    told = _map(files.where(json & (F.col("length") > slice_bytes)).select("path").repartition("path"), _kind, "path string, length bigint, level int")
    single = files.where(json & (F.col("length") <= slice_bytes)).select("path", "length").union(told.where("level = 0").select("path", "length"))
    one = _map(single.repartition("path"), whole, ROW)
    lists = cut(told.where("level > 0"), "level")
    scans = _map(lists.select("path", "level", "k", "start", "stop").repartition("path", "k"), scanned, "path string, level int, k int, a bigint, b bigint, out0 int, deep0 int, out1 int, deep1 int")
    # The state at each slice's begin: a fold over a file's slices, a short row each.
    each = F.array_sort(F.collect_list(F.struct("k", "a", "b", "out0", "deep0", "out1", "deep1")))
    state = "struct<inside:int,depth:int,done:array<struct<a:bigint,b:bigint,inside:int,depth:int>>>"
    fold = f"""aggregate(each, cast((0, 0, array()) as {state}), (s, x) -> cast((IF(s.inside = 0, x.out0, x.out1), s.depth + IF(s.inside = 0, x.deep0, x.deep1), array_append(s.done, named_struct('a', x.a, 'b', x.b, 'inside', s.inside, 'depth', s.depth))) as {state}), s -> s.done)"""
    known = scans.groupBy("path", "level").agg(each.alias("each")).select("path", "level", F.explode(F.expr(fold)).alias("s")).select("path", "level", "s.*")

    def sliced(at: str, level: int, a: int, b: int, inside: int, depth: int) -> Iterator[tuple]:
        return _sliced(at, level, a, b, inside, depth, longest)

    listed = _map(known.repartition("path", "a"), sliced, ROW)
    entries = _map(files.where(zips).select("path").repartition("path"), _entries, "path string, name string, state string")
    packed = _map(entries.repartition("path", "name"), lambda at, name, state: _entry(at, name, state, longest), ROW)
    other = files.where(~(lines | json | zips)).select("path", F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit("not_json"))
    return by_line.union(one).union(listed).union(packed).union(other)
