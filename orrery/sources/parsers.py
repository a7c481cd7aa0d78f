"""Document parsers: bytes of a file to text and metadata, a row a file, in Arrow batches. PDF is not read (no parser is at hand)."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = {
    "json": "json", "csv": "csv", "tsv": "tsv", "html": "html", "htm": "html", "xml": "xml", "xlsx": "xlsx", "xlsm": "xlsx", "pdf": "pdf", "enl": "endnote", "enlx": "endnote",
    "enlp": "endnote", "docx": "docx", "docm": "docx", "dotx": "docx", "dotm": "docx", "txt": "txt", "text": "txt", "md": "txt",
}
MIME = {
    "application/json": "json", "text/json": "json", "text/csv": "csv", "application/csv": "csv", "text/tab-separated-values": "tsv", "text/html": "html",
    "application/xhtml+xml": "html", "text/xml": "xml", "application/xml": "xml", "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "txt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}


def detect_format(name: Column, mime: Column) -> Column:
    """By the name's extension (query and fragment cut), else by media type with +json and +xml; else unknown."""
    bare = F.regexp_replace(F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"^[^?#]*", 0), r"[/\\]+$", "")
    ext = F.lower(F.regexp_extract(bare, r"([^./\\]*)$", 1))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_mime = F.coalesce(F.element_at(table(MIME), kind), F.when(kind.endswith("+json"), "json").when(kind.endswith("+xml"), "xml"))
    return F.coalesce(F.element_at(table(FORMATS), ext), by_mime, F.lit("unknown"))


def parse_txt(data: bytes) -> tuple[str, dict]:
    text = data.decode("utf-8", "replace")
    return text.removeprefix("\ufeff"), {}


# Words that name columns.
HEADER_LABELS = frozenset(
    "account age amount author category class code company comment contract created customer date description email file first id key language last name note notes owner path price "
    "priority repo score source status symbol tag tenant tier time title type updated url user value year".split()
)
# end of fixed values


def _is_number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def _names_column(cell: str) -> bool:
    low = cell.lower()
    return "_" in cell or "-" in cell or low in HEADER_LABELS or all(w in HEADER_LABELS for w in low.split())


def _may_be_header(cell: str) -> bool:
    letters = [c for c in cell if c.isalpha()]
    if not letters or _is_number(cell):
        return False
    acronym = len(letters) <= 8 and all(c.isupper() for c in letters)
    return not acronym or _names_column(cell)


def rows_to_text(rows: list[list[str | None]]) -> tuple[str, dict]:
    """Blank rows go. The first row that looks like a header is one: rows after it say `header value` for each cell."""
    rows = [[(c or "").strip() or None for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    width = max((sum(c is not None for c in r) for r in rows), default=0)
    out, header, plain, under = [], None, 0, 0
    for i, row in enumerate(rows):
        cells = [c for c in row if c]
        if header is not None:
            under += 1
            named = [f"{header[j]} {c}" if j < len(header) and header[j] else c for j, c in enumerate(row) if c]
            out.append(" ".join(named))
            continue
        out.append(" ".join(cells))
        wide = len(cells) > 1 or (width <= 1 and len(cells) == 1)
        after = [c for c in rows[i + 1] if c] if i + 1 < len(rows) else []
        if wide and all(map(_may_be_header, cells)) and (any(map(_names_column, cells)) or any(not _may_be_header(c) for c in after)):
            header = row
        else:
            plain += 1
    return "\n".join(out), {"rows": under if header is not None else plain, "columns": width}


def parse_csv(data: bytes, delimiter: str = ",") -> tuple[str, dict]:
    return rows_to_text(list(csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter=delimiter)))


def parse_json(data: bytes) -> tuple[str, dict]:
    """Values in order; a nested key says `key value full.path value`, a null only its key."""

    def flat(v, path: str) -> str:
        if isinstance(v, dict):
            parts = []
            for k, x in v.items():
                full = f"{path}.{k}" if path else k
                inner = flat(x, full)
                parts.append(full if not inner else f"{k} {inner}" if full == k else f"{k} {inner} {full} {inner}")
            return " ".join(parts)
        if isinstance(v, list):
            return " ".join(flat(x, path) for x in v)
        return "" if v is None else v if isinstance(v, str) else json.dumps(v)

    value = json.loads(data)
    return flat(value, ""), {"kind": "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "primitive"}


def parse_xml(data: bytes) -> tuple[str, dict]:
    """Text and attributes with their element, and again with the dotted path where the element is nested."""
    out, count = [], 0

    def walk(e: ElementTree.Element, above: list[str]) -> None:
        nonlocal count
        count += 1
        path = [*above, e.tag]
        full = ".".join(path)

        def say(suffix: str, value: str) -> None:
            short = f"{e.tag}{' ' + suffix if suffix else ''} {value}"
            long = f"{full}{'.' + suffix if suffix else ''} {value}"
            out.append(short if len(path) == 1 else f"{short} {long}")

        for k, v in e.attrib.items():
            if v.strip():
                say(k, v.strip())
        if e.text and e.text.strip():
            say("", e.text.strip())
        for child in e:
            walk(child, path)
            if child.tail and child.tail.strip():
                say("", child.tail.strip())

    walk(ElementTree.fromstring(data), [])
    return " ".join(out), {"element_count": count}


class _Text(HTMLParser):
    """Visible text runs; hidden subtrees are skipped; alt, aria-label and title attributes are said."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    SKIP = frozenset("script style noscript template".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.hidden, self.open = [], [], 0, []

    @staticmethod
    def _unseen(tag: str, attrs: dict) -> bool:
        if tag in _Text.SKIP or "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true":
            return True
        won: dict[str, tuple[bool, str]] = {}
        for part in (attrs.get("style") or "").lower().split(";"):
            name, _, value = part.partition(":")
            forced = value.rstrip().endswith("!important")
            value = value.replace("!important", "").strip()
            if name.strip() in ("display", "visibility") and (forced or not won.get(name.strip(), (False,))[0]):
                won[name.strip()] = (forced, value)
        return won.get("display", (0, ""))[1] == "none" or won.get("visibility", (0, ""))[1] in ("hidden", "collapse")

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        unseen = self._unseen(tag, attrs)
        if not self.hidden and not unseen:
            self.out += [attrs[a].strip() for a in ("alt", "aria-label", "title") if attrs.get(a) and attrs[a].strip()]
        if tag not in self.VOID:
            self.open.append((tag, unseen))
            self.hidden += unseen

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, unseen = self.open.pop()
                self.hidden -= unseen
                if t == tag:
                    break

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or self.hidden:
            return
        (self.title if self.open and self.open[-1][0] == "title" else self.out).append(text)


def parse_html(data: bytes) -> tuple[str, dict]:
    p = _Text()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    text, title = " ".join(p.out), " ".join(p.title)
    if title and not re.search(rf"(?<!\w){re.escape(title)}(?!\w)", text):
        text = f"{title} {text}" if text else title
    return text, {"title": title} if title else {}


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_xlsx(data: bytes) -> tuple[str, dict]:
    """Sheets in order; shared strings; cells at their places, so gaps are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        texts, rows_n = [], 0
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0])):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(_MAIN + "row"):
                cells: list[str | None] = []
                for c in row.iter(_MAIN + "c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    place = len(cells)
                    if letters:
                        place = 0
                        for ch in letters[0]:
                            place = place * 26 + ord(ch) - 64
                        place -= 1
                    value = c.findtext(_MAIN + "v")
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = value
                rows.append(cells)
            text, meta = rows_to_text(rows)
            rows_n += meta["rows"]
            if text:
                texts.append(text)
    return "\n".join(texts), {"rows": rows_n, "sheets": len(texts)}


def parse_docx(data: bytes) -> tuple[str, dict]:
    """Paragraphs, and table rows with tabs, in order. Documents with macros, ActiveX or embedded objects are marked complex."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        complex_ = any(n.startswith(("word/activeX/", "word/embeddings/")) or n.endswith("vbaProject.bin") for n in names)
    said = lambda e: "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" for t in e.iter() if t.tag in (_W + "t", _W + "tab", _W + "br"))
    out = []
    for e in body if body is not None else ():
        if e.tag == _W + "p":
            out.append(said(e))
        elif e.tag == _W + "tbl":
            out += ["\t".join(" ".join(said(p) for p in c.iter(_W + "p")) for c in r.iter(_W + "tc")) for r in e.iter(_W + "tr")]
    return "\n".join(x for x in out if x.strip()), {"complex": complex_}


_RIS = re.compile(r"^([A-Z][A-Z0-9])  - ?(.*)$", re.M)


def parse_endnote(data: bytes) -> tuple[str, dict]:
    """References from EndNote XML, or from RIS lines: one line each, and the distinct sorted years, journals and types."""
    text = data.decode("utf-8", "replace")
    refs: list[dict] = []
    if "<record" in text:
        root = ElementTree.fromstring(text[text.index("<") :])
        joined = lambda r, path: [" ".join("".join(e.itertext()).split()) for e in r.iterfind(path)]
        for r in root.iter("record"):
            kind = r.find("ref-type")
            refs.append({"authors": joined(r, ".//authors/author"), "title": joined(r, ".//titles/title"), "journal": joined(r, ".//periodical/full-title") or joined(r, ".//titles/secondary-title"), "year": joined(r, ".//dates/year"), "type": [kind.get("name", "")] if kind is not None else []})
    else:
        for block in re.split(r"^ER  -.*$", text, flags=re.M):
            tags: dict[str, list[str]] = {}
            for k, v in _RIS.findall(block):
                tags.setdefault(k, []).append(v.strip())
            if tags:
                refs.append({"authors": tags.get("AU", []) + tags.get("A1", []), "title": tags.get("TI", []) + tags.get("T1", []), "journal": tags.get("JO", []) + tags.get("JF", []) + tags.get("T2", []), "year": [y[:4] for y in tags.get("PY", []) + tags.get("Y1", [])], "type": tags.get("TY", [])})
    lines = [". ".join(x for x in ("; ".join(r["authors"]), " ".join(r["title"][:1]), " ".join(r["journal"][:1]), " ".join(r["year"][:1])) if x) for r in refs]
    listed = lambda k: sorted({x for r in refs for x in r[k][:1] if x})
    return "\n".join(lines), {"references": len(refs), "years": listed("year"), "journals": listed("journal"), "types": listed("type")}


PARSERS = {"txt": parse_txt, "csv": parse_csv, "tsv": lambda d: parse_csv(d, "\t"), "json": parse_json, "xml": parse_xml, "html": parse_html, "xlsx": parse_xlsx, "docx": parse_docx, "endnote": parse_endnote}


def parse_documents(files: DataFrame, content: str = "content", kind: str = "format") -> DataFrame:
    """Adds text, word_count, meta (JSON) and error to files with a binary column and a format. A file that can't be read, or of an
    unknown format, has its error and no text; the others go on."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"text": [], "word_count": [], "meta": [], "error": []}
            for data, name in zip(b.column(b.schema.get_field_index(content)).to_pylist(), b.column(b.schema.get_field_index(kind)).to_pylist(), strict=True):
                text = meta = error = None
                try:
                    text, meta = PARSERS[name](bytes(data or b""))
                except KeyError:
                    error = f"no parser for {name}"
                except Exception as e:  # a broken file is a row with its error
                    error = f"{type(e).__name__}: {e}"[:500]
                for k, v in (("text", text), ("word_count", None if text is None else len(text.split())), ("meta", None if meta is None else json.dumps(meta, sort_keys=True)), ("error", error)):
                    out[k].append(v)
            cols = [pa.array(out["text"], pa.string()), pa.array(out["word_count"], pa.int64()), pa.array(out["meta"], pa.string()), pa.array(out["error"], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *out])

    more = [StructField("text", StringType()), StructField("word_count", LongType()), StructField("meta", StringType()), StructField("error", StringType())]
    return files.mapInArrow(run, StructType([*files.schema.fields, *more]))
