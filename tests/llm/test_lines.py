import random
import re

from flowlab.llm.lines import clean_lines


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = {}
    for i in range(len(w) - 4):
        runs.setdefault(tuple(w[i:i + 5]), []).append(i)
    again = {i + k for v in runs.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = ["a", "b", "the", "Été.", "x#", "\t", "\n", "\n", "日本", "&|", "\x0b", " "]
    texts = [None, "", " \n ", "one two three four five", "a b c d e a b c d e", "q " * 30000]
    texts += [" ".join(rng.choices(vocab, k=rng.randrange(120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2, 3)],
                                 "doc_id long, text string, n_words int, w_ int, `odd.name x` int")
    rows = clean_lines(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert clean_lines(docs.filter("false")).count() == 0


def test_line_rules(spark):
    good = "This is a line of ordinary prose, and it ends well.\nSo does this second one, which is not short."
    texts = {1: good, 2: good + "\nHome | News | Sport | Login", 3: "Home | News | Sport | Login\n" * 1 + "A b c d e f g h i j", 4: good + "\nAll rights reserved."}
    texts[5] = "Home | News | Sport | Login | More\nEnable JavaScript to go on now\nthe end of it all here"
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 4, 5)] == [True, True, True, False]
    assert got[2].clean_text == good and got[4].clean_text == good and got[2].n_lines_removed == 1
