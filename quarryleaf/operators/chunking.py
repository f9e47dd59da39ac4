"""Markdown to chunks: heading-aware, table-preserving, bounded in size.

Sections and record spans are ordered folds over lines, and packing is greedy,
so a page is chunked by one Arrow-batched Python function; all that follows
(filters, numbering, ranking) is declarative.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PLAIN = 20
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")
_RECORD = re.compile(r"^\[\[REC\|(\d+)\|(\d+)\]\]$")
_RECORD_END = re.compile(r"^\[\[RECEND\|(\d+)\]\]$")


def record_mark(group: int, index: int) -> str:
    """The line that begins a record in annotated text."""
    return f"[[REC|{group}|{index}]]"


def record_end(group: int) -> str:
    return f"[[RECEND|{group}]]"


def sections(md: str) -> list[tuple[list[str], list[str]]]:
    """(heading path, body lines) in order. A heading closes those of its level
    and below, and is not in its body; code fences are not looked at."""
    out: list[tuple[list[str], list[str]]] = []
    path: dict[int, str] = {}
    body: list[str] = []
    seen = False
    for line in [*md.split("\n"), None]:
        m = _HEADING.match(line) if line is not None else None
        if line is not None and not m:
            body.append(line)
            continue
        if body:
            out.append(([path[k] for k in sorted(path)], body))
        body = []
        if m:
            seen = True
            path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
    return out or ([] if seen and md.strip() == "" else [([], md.split("\n"))])


def spans(lines: list[str]) -> Iterator[tuple[str, int | None, int | None]]:
    """(text, group, index) of a section's lines: what is in a record apart from
    what is not. Marks are whole lines and belong to no text."""
    group = index = None
    held: list[str] = []
    for line in [*lines, None]:
        start = _RECORD.match(line.strip()) if line is not None else None
        end = _RECORD_END.match(line.strip()) if line is not None else None
        if line is not None and not start and not end:
            held.append(line)
            continue
        if held:
            yield "\n".join(held), group, index
        held = []
        group, index = (int(start[1]), int(start[2])) if start else (None, None)


def split_long(line: str, most: int) -> list[str]:
    """By sentences, a sentence over the limit by words, a word over it
    anywhere: as few pieces as a greedy pass gives, parts joined by a space,
    whatever stood between them."""
    if len(line) <= most:
        return [line]
    out = [""]
    closed = True  # the last piece takes no more

    def put(part: str) -> None:
        nonlocal closed
        if closed or len(out[-1]) + 1 + len(part) > most:
            out.append(part)
        else:
            out[-1] += " " + part
        closed = False

    sentences = [s for s in _SENTENCE.split(line) if s]
    for sentence in sentences:
        if len(sentence) <= most:
            put(sentence)
            continue
        closed = True
        words = sentence.split(" ")
        for word in words:
            if len(word) <= most:
                put(word)
            else:
                out += [word[i : i + most] for i in range(0, len(word), most)]
                closed = True
        closed = True
    return [piece.strip() for piece in out[1:]]


def pieces(body: str, most: int) -> list[str]:
    """Lines packed up to the limit. A table is never cut, however long."""
    if len(body) <= most:
        return [body]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for line in body.split("\n"):
        table = bool(_TABLE.match(line))
        if not table and (len(line) > most or size + len(line) + 1 > most):
            out += ["\n".join(held).strip()] * bool(held)
            held, size = [], 0
        if not table and len(line) > most:
            out += split_long(line, most)
        else:
            held.append(line)
            size += len(line) + 1
    return out + ["\n".join(held).strip()] * bool(held)


_IMAGE, _LINK, _URL, _SPACE = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\]]*)\]\([^)]*\)"), re.compile(r"https?://\S+"), re.compile(r"\s+")


def plain(md: str) -> str:
    return _SPACE.sub(" ", _URL.sub("", _LINK.sub(r"\1", _IMAGE.sub("", md)))).strip()


def chunk(md: str | None, most: int | None = None) -> list[dict]:
    """Chunks of a page in order, numbered from 0 without gaps. Those that are
    blank or have under ``LEAST_PLAIN`` plain characters are dropped; a record
    is one chunk whatever its size. By default short pages get larger chunks."""
    if not md or not md.strip():
        return []
    most = most or (900 if len(md) < 20_000 else 450)
    out: list[dict] = []
    for path, lines in sections(md):
        for text, group, index in spans(lines):
            for piece in map(str.strip, [text] if group is not None else pieces(text, most)):
                clear = plain(piece)
                if piece and len(clear) >= LEAST_PLAIN:
                    out.append({"chunk_index": len(out), "text": piece, "heading_path": path, "heading": " > ".join(path), "char_count": len(piece), "embed_text": clear, "record_group_id": group, "record_index": index})
    return out


_CHUNK = "struct<chunk_index:int,text:string,heading_path:array<string>,heading:string,char_count:int,embed_text:string,record_group_id:int,record_index:int>"
_ARROW = pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("heading", pa.string()), ("char_count", pa.int32()), ("embed_text", pa.string()), ("record_group_id", pa.int32()), ("record_index", pa.int32())]))


def chunk_pages(pages: DataFrame, md_col: str = "md", max_chars: int | None = None) -> DataFrame:
    """A row for each chunk of each page, beside the page's other columns."""

    def run(md: pa.Array) -> pa.Array:
        return pa.array([chunk(x.as_py(), max_chars) for x in md], _ARROW)

    made = F.arrow_udf(run, f"array<{_CHUNK}>")(F.col(md_col))
    rest = [c for c in pages.columns if c != md_col]
    return pages.select(*rest, F.explode(made).alias("_chunk")).select(*rest, "_chunk.*")
