"""Chunkers of prose and code, as table functions over Arrow batches; code edges as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]+")


def count_tokens(text: str) -> int:
    """The conservative estimate of orrery.functions.text, in Python."""
    return sum(-(-len(m) // 4) for m in _RUN.findall(text)) + 2 * sum(c > "\x7f" for c in text)


def line_chunks(text: str, max_chars: int) -> list[tuple[int, int, str]]:
    """(start byte, end byte, text): whole lines while they fit; a longer line is cut every max_chars; blank slices are dropped."""
    pieces: list[list[str]] = []
    room = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        if len(line) > max_chars:
            pieces += [[line[i : i + max_chars]] for i in range(0, len(line), max_chars)]
            room = 0
        elif room >= len(line):
            pieces[-1].append(line)
            room -= len(line)
        else:
            pieces.append([line])
            room = max_chars - len(line)
    out, at = [], 0
    for p in pieces:
        chunk = "".join(p)
        size = len(chunk.encode())
        if chunk.strip():
            out.append((at, at + size, chunk))
        at += size
    return out


_SENTENCE = re.compile(r".+?(?:[.!?…]+[\"'”’)\]]*(?=\s|$)|\n{2,}|$)\s*", re.S)


def sentence_chunks(text: str, target: int = 512, overlap: int = 50) -> list[tuple[int, int, str]]:
    """(start byte, end byte, text) of sentences packed up to a token target; a chunk starts again with the last sentences of the one
    before, up to `overlap` tokens. A sentence over the target is cut at white space. Tokens are the conservative estimate."""
    spans = []
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        while count_tokens(text[a:b]) > target:
            cut, cost = a, 0
            for w in re.finditer(r"\S+\s*", text[a:b]):
                cost += count_tokens(w[0])
                if cost > target and cut > a:
                    break
                cut = a + w.end()
            if cut >= b:
                break
            spans.append((a, cut))
            a = cut
        if a < b:
            spans.append((a, b))
    used = first = 0
    costs = [count_tokens(text[a:b]) for a, b in spans]
    chunks = []
    for i, cost in enumerate(costs):
        if used and used + cost > target:
            chunks.append((first, i))
            first, used = i, 0
            while first > chunks[-1][0] + 1 and used + costs[first - 1] <= overlap and used + costs[first - 1] + cost <= target:
                first -= 1
                used += costs[first]
        used += cost
    if spans:
        chunks.append((first, len(spans)))
    found = []
    for i, j in chunks:
        a, b = spans[i][0], spans[j - 1][1]
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        body = body.strip()
        if body:
            byte = len(text[:a].encode())
            found.append((byte, byte + len(body.encode()), body))
    return found


_STARTS: dict[str, list[tuple[str, re.Pattern]]] = {
    "rust": [
        (k, re.compile(rf"^(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*{w}\s+(?P<name>[A-Za-z_]\w*|[^{{]+)"))
        for k, w in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("impl", r"impl(?:<[^>]*>)?"), ("module", "mod"))
    ],
    "python": [("function", re.compile(r"^(?:async )?def (?P<name>\w+)")), ("class", re.compile(r"^class (?P<name>\w+)"))],
    "javascript": [
        ("function", re.compile(r"^(?:export )?(?:default )?(?:async )?function\s*\*?\s*(?P<name>[\w$]*)")),
        ("class", re.compile(r"^(?:export )?(?:default )?class\s+(?P<name>[\w$]+)")),
        ("function", re.compile(r"^(?:export )?(?:const|let|var)\s+(?P<name>[\w$]+)[^;]*(?:=>|function)")),
    ],
    "go": [("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)"))],
}
_STARTS["typescript"] = _STARTS["javascript"]
_LEAD = {"rust": re.compile(r"^\s*(#\[|///|//!|/\*\*|\*)"), "python": re.compile(r"^@")}
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*$")


def code_chunks(source: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, text) of top-level symbols with what decorates them; one `file` chunk for other languages
    and for files without symbols."""
    lines = source.splitlines()
    out, i, depth = [], 0, 0
    braces = language != "python"
    while i < len(lines):
        hit = next(((k, m) for k, p in _STARTS.get(language, ()) if (m := p.match(lines[i]))), None) if depth == 0 else None
        if hit is None:
            if braces:
                bare = _QUOTED.sub("", lines[i])
                depth = max(0, depth + bare.count("{") - bare.count("}"))
            i += 1
            continue
        end = _block_end(lines, i, braces)
        first = i
        while first > (out[-1][3] if out else 0) and language in _LEAD and _LEAD[language].match(lines[first - 1]):
            first -= 1
        out.append((hit[0], (hit[1]["name"] or "").strip(), first + 1, end + 1, "\n".join(lines[first : end + 1])))
        i = end + 1
    return out or ([("file", "", 1, len(lines), source)] if source.strip() else [])


def _block_end(lines: list[str], i: int, braces: bool) -> int:
    if not braces:
        end = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip() and not lines[j][0].isspace() and not lines[j].startswith((")", "]", "}")):
                break
            if lines[j].strip():
                end = j
        return end
    depth, opened = 0, False
    for j in range(i, len(lines)):
        bare = _QUOTED.sub("", lines[j])
        depth += bare.count("{") - bare.count("}")
        opened |= "{" in bare
        if (opened and depth <= 0) or (not opened and bare.rstrip().endswith(";")):
            return j
    return len(lines) - 1


def segments(chunks: list[tuple[str, str, int, int, str]], source: str, max_chars: int) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, text): neighbouring symbols together up to max_chars, gaps kept with the symbol after; at most four
    names and the number of the others."""
    lines = source.splitlines()
    bounds, at = [], 0
    for _, name, _, last, _ in chunks:
        bounds.append((at, last, name))
        at = last
    if at < len(lines):
        bounds.append((at, len(lines), ""))
    out: list[list] = []
    for a, b, name in bounds:
        size = len("\n".join(lines[a:b]))
        if out and out[-1][3] + size + 1 <= max_chars:
            out[-1][1], out[-1][3] = b, out[-1][3] + size + 1
            out[-1][2].append(name)
        else:
            out.append([a, b, [name], size])
    joined = lambda names: ", ".join(names[:4]) + (f" +{len(names) - 4} more" if len(names) > 4 else "")
    return [(joined([n for n in names if n]), a + 1, b, "\n".join(lines[a:b])) for a, b, names, _ in out if "\n".join(lines[a:b]).strip()]


def explode_chunks(docs: DataFrame, cut: Callable[[str], list[tuple[int, int, str]]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, start, end, chunk) by a chunker of text; null texts have none."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, *c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for i, c in enumerate(cut(t))]
            if rows:
                kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "chunk_index", "start", "end", "chunk"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, chunk_index int, start long, end long, chunk string")


def chunk_id(content_hash: Column, index: Column) -> Column:
    return F.concat(content_hash, F.lit(":"), index.cast("string"))


def path_chunk_id(path: Column, index: Column) -> Column:
    """The first 16 hex digits of the path's sha-256, and the place."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 16), F.lit("-"), index.cast("string"))


def code_edges(files: DataFrame, source: str = "source", language: str = "language") -> DataFrame:
    """(file, kind, target) told by lines: imports, and in Rust calls of paths with a lower-case last part."""
    own = files.select("file", F.col(language).alias("language"), F.explode(F.split(source, "\n")).alias("line")).withColumn("line", F.trim("line"))
    lang, line = F.col("language"), F.col("line")
    py = F.regexp_extract(line, r"^(?:import|from) (\S+)", 1)
    js = F.regexp_extract(line, r"^import .* from ['\"]([^'\"]+)['\"]", 1)
    rs = F.trim(F.regexp_extract(line, r"^use (.+?)(?: as .*)?;*$", 1))
    go = F.regexp_extract(line, r"^(?:import )?\"([^\"]+)\"$", 1)
    target = F.when(lang == "python", py).when(lang.isin("javascript", "typescript"), js).when(lang == "rust", rs).when(lang == "go", go)
    imports = own.select("file", F.lit("imports").alias("kind"), target.alias("target"))
    called = F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}_]+(?:::[\p{L}\p{N}_]+)*::(\p{Ll}[\p{L}\p{N}_]*)(?![\p{L}\p{N}_:])"), F.lit(1))
    calls = own.filter(lang == "rust").select("file", F.lit("calls").alias("kind"), F.explode(called).alias("target"))
    return imports.unionByName(calls).filter("target <> ''").distinct()
