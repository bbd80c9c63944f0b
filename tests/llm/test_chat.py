import hashlib
import random

import pytest

from flowlab.llm.chat import CODES, chat_windows, digest_conversations, escape, read_windows, unescape


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def make():
    rng = random.Random(4)
    parts = ["<s>[", "]\n", "</s>", "\\", "\\l", "[INST]", "ok", "é 日", "\n", " word", "\\e\\b"]
    rows = []
    for c in range(25):
        for t in range(rng.choice([1, 2, 5, 40, 200])):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "a]b\n<"])
            rows.append((c, t if c % 5 else t // 2, role, None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randrange(12)))))
    return rows + [(None, 0, "assistant", "alone"), (99, None, "user", "first"), (99, 0, "assistant", "x " * 500), (98, 0, "system", "only")]


@pytest.mark.parametrize("budget,history", [(256, 64), (20, 5), (10, 100)])
def test_round_trip(spark, budget, history):
    rows = make()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(6)
    windows = chat_windows(turns, budget, history).cache()
    got = {r.conv_id: r for r in digest_conversations(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha(said), len(learnt), sha(learnt))
    assert len(got) == len({r[0] for r in rows})
    for w in windows.collect():
        pieces = w.formatted.split("</s>\n")[:-1]
        assert len(pieces) == w.n_turns and all(p.startswith("<s>[") for p in pieces)
        if w.conv_id is not None and w.conv_id % 3 == 0 and w.conv_id % 5 and w.conv_id < 25:
            assert pieces[0].startswith("<s>[system]\n")
        last = len(pieces[-1].split()) + 20
        assert w.n_tokens <= max(budget, history + 1) + last or w.n_turns - w.n_repeated == 1


def test_escape_is_reversible(spark):
    texts = ["".join(x) for x in (["\\", "e"], ["\\", "l"], ["<", "\\", "["], ["]", "\\", "\\", "b"], ["plain"])]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape("t").alias("e"), unescape(escape("t")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c, _ in CODES[1:])


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_windows(chat_windows(none)).count() == 0
