import hashlib
import random

from pyspark.sql import functions as F

from parchmint.llm import chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formatted(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.withColumn("parts", chat.parts_of_text(F.col("text"))))


def test_round_trip(spark):
    rng = random.Random(1)
    pieces = ["<", ">", "\\", "\\l", "\\b", "\\g", "</turn>\n", "<turn:assistant>\n", "\n", "é", "\U0001f600", "</turn>", "l", "b", "<image:0.0>", " "]
    turns = [(c, k, rng.choice(["user", "assistant", "a>b\n<c\\"]), "".join(rng.choices(pieces, k=rng.randrange(12)))) for c in range(60) for k in range(rng.randrange(1, 6))]
    turns.append((-7, 0, "assistant", "\\### Assistant: </turn> ok"))
    got = {r.conv_id: r for r in chat.digests(formatted(spark, turns)).collect()}
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[c]
        assert r.n_turns == len(own) and r.turns_sha256 == digest("".join(f"{role}\n{t}\n" for _, _, role, t in own))
        assert r.loss_chars == len(loss) and r.loss_sha256 == digest(loss)


def test_layout_and_mask(spark):
    r = formatted(spark, [(1, 1, "assistant", "a<b"), (1, 0, "user", "x\\y")]).first()
    assert r.formatted == "<turn:user>\nx\\by</turn>\n<turn:assistant>\na\\lb</turn>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["a\\lb"]
    assert r.attachments == [] and r.expanded_tokens == 0


def test_parts(spark):
    part = lambda **k: tuple(k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [
        part(type="text", text="see <this> "), part(type="image", ref="a.png", width=28, height=15), part(type="text", text=" and "),
        part(type="audio", ref="b.wav", seconds=1.01), part(type="document", ref="c.pdf", pages=2), part(type="image", ref="d.png"), part(type=None, text="!"), part(type="video", ref="e"),
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, None, [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns).first()
    assert r.formatted == "<turn:user>\nsee \\lthis> <image:0.1> and <audio:0.3><document:0.4><image:0.5>!</turn>\n<turn:assistant>\n</turn>\n<turn:>\n</turn>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 4), (0, 3, "audio", "b.wav", 26), (0, 4, "document", "c.pdf", 512), (0, 5, "image", "d.png", 1)]
    assert r.expanded_tokens == 543 and [(s.start, s.length) for s in r.loss_spans] == [(r.formatted.index("<turn:assistant>\n") + 17, 0)]
    assert chat.read_back(chat.format_conversations(turns)).first().turns[0].text == "see <this> <image:0.1> and <audio:0.3><document:0.4><image:0.5>!"


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 0, "user", "a"), (1, 0, "user", None), (1, 0, "user", None), (2, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: r for r in chat.digests(formatted(spark, rows)).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == digest("\n\nuser\na\n")
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[1].loss_sha256 == digest("")
    assert got[2].loss_chars == 300_000
    assert formatted(spark, rows[:0]).collect() == []


def test_native(spark):
    plan = chat.digests(formatted(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "")
