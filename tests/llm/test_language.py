import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.llm import language
from leadweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ba", "lo", "ti", "mer"], "bb": ["schn", "urg", "ach", "ei"], "cc": ["ção", "ñe", "já", "ru"]}


def _texts(n, seed=1, words=12):
    drawn = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        made = ["".join(drawn.choice(SYLLABLES[lang], 3)) for _ in range(words)]
        rows.append((i, " ".join(made), lang))
    return rows


def test_gradients_agree_with_differences():
    data, bounds = language._joined([b"hello wor", b"abc", "café au la".encode()])
    windows, row = language.Windows.cut(data, bounds, 6, 2)
    net, lang = language.Network.drawn(3, 5, 1), np.array([0, 1, 2])[row]
    _, found = language.gradients(net, windows, lang)
    drawn = np.random.default_rng(0)
    for weights, slopes in zip(net.weights(), found):
        large = np.argwhere(np.abs(slopes) > 1e-3)
        for at in map(tuple, large[drawn.permutation(len(large))[:8]]):
            before = weights[at]
            losses = []
            for step in (1e-2, -1e-2):
                weights[at] = before + step
                losses.append(language.gradients(net, windows, lang)[0])
            weights[at] = before
            assert slopes[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.02, abs=1e-5)


def test_every_byte_is_labelled_once():
    for sizes in ([0, 1, 5, 6, 7, 100], [0, 0], [], [13]):
        data, bounds = language._joined([b"x" * n for n in sizes])
        windows, row = language.Windows.cut(data, bounds, 6, 2)
        covered = np.zeros(len(data), int)
        for low, high, i in zip(windows.low, windows.high, row):
            covered[low:high] += 1
            assert bounds[i] <= low < high <= bounds[i + 1]
        assert (covered == 1).all()
        assert (windows.own().sum(axis=0) == windows.high - windows.low).all()


def test_windows_in_batches_give_what_single_texts_give():
    net = language.Network.drawn(3, 4, 2)
    texts = [t.encode() for _, t, _ in _texts(700, words=30)] + [b"", b"a"]
    together = language.pooled(net, *language._joined(texts), body=16, context=4)
    for i in (0, 1, 350, 699, 700, 701):
        alone = language.pooled(net, *language._joined([texts[i]]), body=16, context=4)[0]
        assert np.allclose(together[i], alone, atol=1e-5)
    assert np.allclose(together[:700].sum(axis=1), 1, atol=1e-4) and (together[700] == 0).all()


def test_a_window_of_a_whole_text_is_the_plain_recurrence():
    net, data = language.Network.drawn(2, 3, 4), np.frombuffer("añb".encode(), np.uint8)
    def run(table, turn, values):
        h, states = np.zeros(3), []
        for x in values:
            a, u = table[x], h @ turn
            z, r = (1 / (1 + np.exp(-(a[k:k + 3] + u[k:k + 3]))) for k in (0, 3))
            h = z * h + (1 - z) * np.tanh(a[6:] + r * u[6:])
            states.append(h)
        return states
    forth = run(net.byte[:257], net.state[0], data)
    back = run(net.byte[257:], net.state[1], data[::-1])[::-1]
    logits = np.array([f @ net.out[0] + b @ net.out[1] + net.bias for f, b in zip(forth, back)])
    chances = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(language.pooled(net, data, np.array([0, len(data)]))[0], chances.mean(axis=0), atol=1e-5)


def test_each_direction_reads_only_the_context_that_its_own_bytes_need():
    net = language.Network.drawn(3, 5, 2)
    texts = [t.encode() for _, t, _ in _texts(40, words=9)] + [b"a", b"ab" * 8, b"x" * 17, b"y" * 33, bytes(range(256))]
    data, bounds = language._joined(texts)
    for body, context in ((16, 4), (16, 40), (500, 4), (1, 3), (16, 0)):
        windows, _ = language.Windows.cut(data, bounds, body, context)
        whole, (sides, own) = windows.steps(), windows.sides()
        assert own.sum() == len(data) and len(own) == min(body, 256)
        inner = (windows.end - windows.start).max() == body + 2 * context  # some window has context on both sides
        assert len(sides) <= len(own) + context and (not inner or len(sides) == len(whole) - context)
        # The same sums as by running both directions over all of each window.
        chances = language._chances(net, language._states(net, whole), windows)
        expected = np.einsum("tnc,tn->nc", chances, windows.own().astype(np.float32))
        assert np.allclose(language._sums(net, windows), expected, rtol=1e-5, atol=1e-4)


def test_gates_far_out_of_range():
    net = language.Network.drawn(2, 4, 3)
    data, bounds = language._joined([b"some text", b"", b"more of it, longer than a window"])
    for scale in (1e3, -1e3):
        wide = language.Network(net.byte * np.float32(scale), net.state, net.out, net.bias)
        windows, row = language.Windows.cut(data, bounds, 8, 2)
        chances = language._chances(wide, language._states(wide, windows.steps()), windows)
        sums = np.zeros((3, 2))
        np.add.at(sums, row, np.einsum("tnc,tn->nc", chances, windows.own().astype(np.float32)))
        found = language.pooled(wide, data, bounds, body=8, context=2)
        assert np.isfinite(found).all() and np.allclose(found, sums / np.maximum(np.diff(bounds), 1)[:, None], atol=1e-5)


def test_languages_of_unseen_documents(spark):
    rows = _texts(600)
    # The held-out labels are wrong on purpose: they must not be learned.
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "aa").otherwise(F.col("lang")))
    more = spark.createDataFrame([
        (900, None, "aa"), (901, "", "aa"), (902, "123 ... 456", "bb"), (903, "lobati " * 60_000, None),
        (904, "schnurg achei", None), (904, "schnurg achei", None), (None, "ruñeção já", None),
    ], SCHEMA)
    extra = df.unionByName(more).withColumns({"score": F.lit(9), "found": F.lit("x"), "known": F.lit(1), "drawn": F.lit(0), "language": F.lit(0)})
    out = language.identified(extra).collect()
    assert len(out) == 607
    found = {}
    for row in out:
        found.setdefault(row["doc_id"], []).append((row["lang_pred"], row["score"]))
    truth = {i: lang for i, _, lang in rows}
    held = [row for row in out if row["held_out"] and row["doc_id"] < 900]
    assert len(held) > 100 and all(row["lang_pred"] == truth[row["doc_id"]] for row in held)
    assert [found[i] for i in (900, 901, 902)] == [[("und", 0.0)]] * 3
    assert found[903][0][0] == "aa" and found[904][0][0] == "bb" and found[None][0][0] == "cc"
    assert len(found[904]) == 2 and found[904][0] == found[904][1]
    assert all(0 <= row["score"] <= 1 for row in out)


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, None, "aa"), (6, "17", "aa")], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in language.identified(unlabelled).collect()} == {("und", 0.0)}


def test_the_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op11_language_id"](spark, folder)
    told = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    both = found.join(told, "doc_id").collect()
    assert len(both) == 1000 and found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = [r for r in both if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
