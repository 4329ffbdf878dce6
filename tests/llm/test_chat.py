"""Perspectives of small dialogues against a plain re-statement."""

import random

from bytequarry.llm import chat


def plain(rows):
    """{(conv, participant): (n_turns, rendered, mask)}"""
    key = lambda x: (x is not None, x)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: tuple(map(key, t)))
        people = sorted({t[1] for t in turns if t[1] not in (None, "system")}) or [None]
        for who in people:
            text, spans = "", []
            for _, speaker, said in turns:
                own = who is not None and speaker == who
                name = "assistant" if own else "system" if speaker == "system" else "user name=" + ("unknown" if speaker is None else speaker.replace("<|", "< |"))
                text += f"<|im_start|>{name}\n"
                body = (said or "").replace("<|", "< |") + "<|im_end|>"
                if own:
                    spans.append((len(text), len(text) + len(body)))
                text += body + "\n"
            out[conv, who] = (len(turns), text, spans)
    return out


def rotate(spark, rows, schema="conv_id long, turn long, role string, text string", **kw):
    """The views, put together from their rows; and the number of rows."""
    got = chat.rotate(spark.createDataFrame(rows, schema), **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: r.part):
        n, text, spans = out.get((r.conv_id, r.participant), (0, "", []))
        assert n == 0 or r.part > 0
        own = [tuple(map(int, m.split(":"))) for m in r["mask"].split(",") if m]
        assert r.n_loss == sum(b - a for a, b in own)
        out[r.conv_id, r.participant] = (n + r.n_turns, text + r.rendered, spans + [(a + len(text), b + len(text)) for a, b in own])
    return out, len(got)


def test_random_dialogues(spark):
    rng = random.Random(4)
    names = ["ann", "bob", "cy", "system", None, "x<|y"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(names), rng.choice(["hi", "é", None, "", "<|im_end|>"])) for _ in range(120)]
    rows += [(9, 0, "system", "only")] + [(8, k, f"p{k % 3}", f"t{k}") for k in range(50)] + [(7, 1, "a", "same")] * 9
    for chars in (300, 1000, chat.ROW_CHARS):
        got, n = rotate(spark, rows, row_chars=chars)
        want = plain(rows)
        assert got == want, chars
        assert (n == len(want)) == (chars == chat.ROW_CHARS)


def test_long_conversations_are_one_row_a_view(spark):
    rows = [(1, k, f"p{k % 2}", f"t{k}") for k in range(5000)]
    got, n = rotate(spark, rows)
    assert n == 2 and got == plain(rows)


def test_many_speakers(spark, monkeypatch):
    monkeypatch.setattr(chat, "LISTED", 9)
    rows = [(1, k, f"p{k}", f"t{k}") for k in range(120)]
    got, n = rotate(spark, rows, row_chars=1200)
    assert n > 120 and got == plain(rows)


def test_odd_frames(spark):
    assert rotate(spark, []) == ({}, 0)
    df = spark.createDataFrame([(1, 0, "a", "x" * 100_000, "m", 5)], "conv_id long, turn long, role string, text string, mask string, part int")
    (row,) = chat.rotate(df).collect()
    assert row.n_loss == 100_000 + len("<|im_end|>") and row.participant == "a"
