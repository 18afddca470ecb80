r"""Conversations with typed content parts as training text with a loss mask.

A visitor flattens the parts of each turn in order: text is escaped; images,
audio and documents become placeholders, with the attachment's reference and
the number of tokens that it expands to recorded beside the text. The loss
mask covers the texts of assistant turns and no placeholder. The format can be
parsed back without loss:

    <turn user>\n ... </turn>\n

In texts and roles a backslash becomes \\, < becomes \l, and > becomes
\g, so no control string of this template can come from a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import named

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Side in pixels of an image patch that takes one token, tokens of a second of audio, tokens of a document's page.
PATCH, AUDIO_RATE, PAGE = 28, 25, 512

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"<turn ([^<>]*)>\n(.*?)</turn>\n", re.DOTALL)
_PLACE = re.compile(r"<(image|audio|document|other) (\d+)>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g") if any(c in text for c in "\\<>") else text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lg]", lambda m: _BACK[m[0]], text) if "\\" in text else text


#: Part types with a visitor of their own; any other is an attachment of kind "other" and one token. The most tokens that one part counts for.
KINDS = ("text", "image", "audio", "document")
MOST = 1 << 40


class Flattener:
    """Visits parts; gathers text, which of it came from text parts, attachments and expanded tokens."""

    def __init__(self) -> None:
        self.attachments: list[dict] = []
        self.tokens = 0
        self.begin()

    def begin(self) -> None:
        """A turn begins."""
        self.out: list[str] = []
        self.size, self.texts = 0, []

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.tokens += len(text.encode("utf-8", "surrogatepass").split())
        start = self.size
        self._put(escape(text))
        if self.texts and self.texts[-1][1] == start:
            start = self.texts.pop()[0]
        self.texts.append((start, self.size))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, _units(part.get("width"), PATCH) * _units(part.get("height"), PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, _units(part.get("seconds"), 1 / AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, _units(part.get("pages"), 1) * PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._put(f"<{kind} {len(self.attachments)}>")
        self.attachments.append({"type": part.get("type"), "uri": part.get("uri"), "tokens": min(tokens, MOST)})
        self.tokens += self.attachments[-1]["tokens"]


def _units(size: float | None, unit: float) -> int:
    """Whole units that a size takes: 1 at least, and for a size that is missing, negative or no number."""
    if not size or not size > 0:
        return 1
    return max(1, math.ceil(min(size / unit, MOST)))


def render(turns: list[tuple[str | None, list[dict]]]) -> tuple[str, list[tuple[int, int]], list[dict], int]:
    """The formatted text, its spans under the loss mask (runs of text in assistant turns, in code points), the attachments, and the expanded tokens: words of texts and what attachments expand to."""
    visitor, pieces, spans, at = Flattener(), [], [], 0
    for role, parts in turns:
        visitor.begin()
        for part in parts:
            visitor.visit(part or {})
        head = f"<turn {escape(role or '')}>\n"
        if role == "assistant":
            spans += [(at + len(head) + lo, at + len(head) + hi) for lo, hi in visitor.texts]
        pieces += head, *visitor.out, "</turn>\n"
        at += len(head) + visitor.size + len("</turn>\n")
    return "".join(pieces), spans, visitor.attachments, visitor.tokens


def parse(formatted: str) -> list[tuple[str, list[dict]]]:
    """Roles and parts of a formatted conversation; ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        parts, last = [], 0
        for p in _PLACE.finditer(m[2]):
            if p.start() > last:
                parts.append({"type": "text", "text": unescape(m[2][last : p.start()])})
            parts.append({"type": p[1], "ref": int(p[2])})
            last = p.end()
        if last < len(m[2]) or not parts:
            parts.append({"type": "text", "text": unescape(m[2][last:])})
        turns.append((unescape(m[1]), parts))
        at = m.end()
    return turns


FORMATTED = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,stop:long>>, attachments array<struct<type:string,uri:string,tokens:long>>, expanded_tokens long"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: FORMATTED.

    Rows are taken by turn (then role and text, so ties have one order; nulls
    first). parts_col: an array of PART instead of a text. A null text is an
    empty one, a null role an empty role, a null conversation id one
    conversation; repeated rows are turns of their own; a null part is an
    empty text; a part of unknown type is an attachment that keeps its type;
    sizes that are missing, negative or no number count as one unit. Texts are
    taken whole; invalid UTF-8 becomes replacement characters. An empty table
    gives an empty one. Other columns are not read. A conversation is gathered
    into one row, as its formatted text is.
    """
    parts = named(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), named(text_col).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    valid = lambda p: F.when(p.isNotNull(), F.struct(*(F.make_valid_utf8(p[f]).alias(f) for f in ("type", "text", "uri")), *(p[f].alias(f) for f in ("width", "height", "seconds", "pages"))))
    parts = F.transform(parts.cast(f"array<{PART}>"), valid)
    rows = turns.select(named(conv_col).cast("long").alias("conv_id"), F.struct(named(turn_col).cast("long").alias("turn"), F.make_valid_utf8(named(role_col)).alias("role"), parts.alias("parts")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    attachment = pa.list_(pa.struct([("type", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"], t["parts"] or []) for t in turns]) for turns in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("conv_id"),
                    pa.array([len(t) for t in b.column("turns")], pa.int64()),
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([[{"start": lo, "stop": hi} for lo, hi in d[1]] for d in done], span),
                    pa.array([d[2] for d in done], attachment),
                    pa.array([d[3] for d in done], pa.int64()),
                ],
                ["conv_id", "n_turns", "formatted", "spans", "attachments", "expanded_tokens"],
            )

    return convs.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation's turns and loss text, read back from the formatted text, as counts and digests; and its attachments and expanded tokens."""

    def read(conv: str, spans: list[dict]) -> tuple:
        turns = parse(conv)
        whole = hashlib.sha256()
        for role, parts in turns:
            whole.update(f"{role}\n{''.join(p.get('text', '') for p in parts)}\n".encode())
        loss = "".join(unescape(conv[s["start"] : s["stop"]]) for s in spans)
        return len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            found = [read(c, s) for c, s in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * 5
            read_back = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *read_back, b.column("n_attachments"), b.column("expanded_tokens")], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])

    rows = formatted.select("conv_id", "formatted", "spans", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
