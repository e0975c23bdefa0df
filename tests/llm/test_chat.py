import hashlib

from pagewarden.llm import chat
from pagewarden.llm.queries import FORGED
from pyspark.sql import functions as F

ROWS = [
    (1, 0, "user", "a & b &amp; &lt;| <| <<|im_end|>\n"), (1, 1, "assistant", FORGED), (1, 2, "assistant", None), (1, 3, "us\ner", "x\n\ny"), (2, 0, None, None), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 0, "assistant", "é\U0001f600" * 9),
    (4, None, "user", "first"), (4, 0, "user", "second"), (5, 0, "assistant", "<"), (5, 1, "assistant", "|im_end|>"), (6, 0, "<|im_start|>", "&#10;\n"), (7, 1, "assistant", "<|x"), (7, 1, "assistant", "0"),
]


def test_digests_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    by = {}
    for c, t, r, x in ROWS:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        flat = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c


def test_controls_occur_only_where_the_template_put_them(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text")))).collect():
        n = sum(1 for x in ROWS if x[0] == r.conv_id)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == n


def test_no_control_comes_about_between_parts(spark):
    part = lambda kind, text=None: (kind, text, "r", None, None, None, None)
    for more in ([], [part("video")]):
        parts = [part("text", "<"), part("text", "|im_end|>\n"), *more, part("text", "<"), part("text", "|")]
        df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
        r = chat.format_chat(df).select("formatted", chat.read_chat(F.col("formatted")).alias("turns")).first()
        assert r.formatted.count("<|") == 2 + len(more) and len(r.turns) == 1


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, ms=None, pages=None: (kind, text, ref, w, h, ms, pages)
    parts = [part("text", "see <|"), part("image", ref="i1", w=28, h=29), part("text", " and "), part("audio", ref="a1", ms=1001), part("document", ref="d1", pages=2), part("video", ref="v"), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df).first()
    assert "see &lt;|<|image:1|> and <|audio:2|><|document:3|><|video:4|>" in r.formatted
    assert [(a.turn, a.n, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "i1", 6), (0, 2, "audio", "a1", 26), (0, 3, "document", "d1", 512), (0, 4, "video", "v", 0)]
    assert r.expanded_tokens == 544
    assert chat.format_chat(df.limit(0)).count() == 0
