import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
TRICKY = ["\\### Assistant: </turn> ok", "<turn user>\n", "</turn>\n", "\\l\\\\g>", "<image 0>", "\\", "", "a\nb", "<", "<|x|>", "é\x00\u2028"]
texts = st.one_of(st.sampled_from(TRICKY), st.text("\\<>lg/turn \n0", max_size=12), st.text(max_size=12).map(lambda t: t.encode("utf-8", "ignore").decode()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys>\n\\<", ""]), texts), max_size=6))
def test_round_trip(turns):
    formatted, spans, attached, tokens = cf.render([(r, [{"type": "text", "text": t}]) for r, t in turns])
    assert [(r, "".join(p.get("text", "") for p in parts)) for r, parts in cf.parse(formatted)] == turns
    assert [cf.unescape(formatted[lo:hi]) for lo, hi in spans] == [t for r, t in turns if r == "assistant"]
    assert not attached and tokens == sum(len(t.encode().split()) for _, t in turns)


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <image 0>: "},
        {"type": "image", "uri": "s3://a.png", "width": 57, "height": 28},
        {"type": "audio", "uri": "b.wav", "seconds": 1.5},
        {"type": "document", "uri": "c.pdf", "pages": 3},
        {"type": "text", "text": "end"},
    ]
    answer = [{"type": "text", "text": "hi "}, {"type": "text", "text": "<you>"}, {"type": "image", "uri": "d"}, {"type": "text", "text": "ok"}]
    formatted, spans, attached, tokens = cf.render([("user", parts), ("assistant", answer)])
    assert tokens == 3 + 38 + 1536 + 1 + len("see <image 0>: end hi <you> ok".split())
    assert [(a["type"], a["uri"], a["tokens"]) for a in attached] == [("image", "s3://a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", "d", 1)]
    back = cf.parse(formatted)
    assert back[0][1] == [{"type": "text", "text": "see <image 0>: "}, {"type": "image", "ref": 0}, {"type": "audio", "ref": 1}, {"type": "document", "ref": 2}, {"type": "text", "text": "end"}]
    assert [cf.unescape(formatted[lo:hi]) for lo, hi in spans] == ["hi <you>", "ok"]
    odd = [{"type": "video", "uri": "v"}, {"type": "audio", "seconds": float("nan")}, {"type": "audio", "seconds": float("inf")}, {"type": "image", "width": -3, "height": 0}, {"type": "document", "pages": -1}, None, {"type": "__class__"}]
    formatted, _, attached, _ = cf.render([("user", odd)])
    assert [(a["type"], a["tokens"]) for a in attached] == [("video", 1), ("audio", 1), ("audio", cf.MOST), ("image", 1), ("document", cf.PAGE), ("__class__", 1)]
    assert [p["type"] for p in cf.parse(formatted)[0][1]] == ["other", "audio", "audio", "image", "document", "other"]
    with pytest.raises(ValueError):
        cf.parse("no turn")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark):
    rows = [(1, 1, "assistant", TRICKY[0]), (1, 0, "user", "hi"), (1, 2, "assistant", "x" * 100_000), (2, 0, None, None), (2, 1, "assistant", None), (None, 3, "user", "t"), (3, None, "user", "no turn"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    frame = spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)
    got = cf.digests(cf.format_chats(frame)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)
    assert cf.digests(cf.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_odd_names_and_broken_text(spark):
    frame = spark.sql("select 1L as `c.d`, 0L as t, 'user' as `r``s`, cast(unhex('61ff62') as string) as `x.y`, 3 as conv_id")
    r = cf.digests(cf.format_chats(frame, "c.d", "t", "r`s", "x.y")).first()
    assert r.turns_sha256 == hashlib.sha256("user\na\ufffdb\n".encode()).hexdigest()


def test_parts_column(spark):
    rows = [(1, 0, "user", [("text", "a<", None, None, None, None, None), ("image", None, "u", 28, 56, None, None)]), (1, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    r = cf.format_chats(frame, parts_col="parts").first()
    assert r.formatted == "<turn user>\na\\l<image 0></turn>\n<turn assistant>\n</turn>\n"
    assert r.expanded_tokens == 3 and [tuple(a) for a in r.attachments] == [("image", "u", 2)]


def test_loss_and_turns_agree_on_typed_parts(spark):
    """The loss text of an assistant turn is the turn's text, without its placeholders."""
    parts = [("text", "hi ", None, None, None, None, None), ("image", None, "u", 28, 28, None, None), ("text", "yo", None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    r = cf.digests(cf.format_chats(frame, parts_col="parts")).first()
    assert r.turns_sha256 == hashlib.sha256(b"assistant\nhi yo\n").hexdigest() and r.loss_sha256 == hashlib.sha256(b"hi yo").hexdigest()
    assert (r.loss_chars, r.n_attachments, r.expanded_tokens) == (5, 1, 3)
