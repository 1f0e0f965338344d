import numpy as np
from pyspark.sql import functions as F

from tintframe.llm import language_id

SYLLABLES = {"aa": "the and ing shun wor thre".split(), "bb": "cão ção ñor que llo rra".split(), "cc": "sch ung ßen über ach keit".split()}


def corpus(n=300):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang], 2)) for _ in range(5 + i % 60)), lang))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    docs = corpus() + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "cc"), (903, "schung keit " * 30_000, None), (None, "the shun", "aa")]
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, lang string, lang_pred boolean")
    rows = language_id.identify(df, sample_docs=240, epochs=6).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" for i in (900, 901, 902)) and by_id[903].lang_pred == "cc"
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and np.mean([r.lang_pred == sorted(SYLLABLES)[r.doc_id % 3] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(df).collect()] == ["und"]
    assert language_id.identify(df.limit(0)).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(97, 105, (8, 24)).astype(np.int16), rng.integers(0, 2, 8)
    net = language_id.ByteConvNet(2, window=24, widths=(2, 3), filters=3, embedding=4)
    loss = lambda: -net.log_probabilities(codes)[np.arange(8), labels].mean()
    before = loss()
    net.train(codes, labels, epochs=30, batch=8, rate=0.01)
    assert loss() < 0.7 * before


def test_windows_hold_every_byte():
    text = bytes(range(1, 200))
    codes = language_id.windows(text, 64).reshape(-1)
    assert codes[codes != 256].astype(np.uint8).tobytes() == text


def plain(net, code):
    """The forward pass of one window, place by place and filter by filter."""
    at = lambda i: net.embed[code[i] if i < len(code) else 256]
    best = []
    for f in range(net.conv.shape[1]):
        width = int(net.mask[:, f].sum()) // net.dim
        best.append(max(sum(float(at(i + j) @ net.conv[j * net.dim : (j + 1) * net.dim, f]) for j in range(width)) for i in range(len(code))) + float(net.bias[f]))
    logits = np.maximum(best, 0) @ net.out + net.out_bias
    return logits - np.log(np.exp(logits).sum())


def small_net():
    rng = np.random.default_rng(4)
    net = language_id.ByteConvNet(3, window=17, widths=(2, 3, 4), filters=2, embedding=3, seed=9)
    for k in ("embed", "conv", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.bias += rng.normal(0, 0.1, len(net.bias))
    codes = rng.integers(97, 110, (6, 17)).astype(np.int16)
    codes[5, 9:] = 256
    return net, codes, rng.integers(0, 3, 6)


def test_forward_pass_against_plain_loops():
    net, codes, _ = small_net()
    assert np.allclose(net.log_probabilities(codes), [plain(net, c) for c in codes])


def test_gradients_against_differences():
    net, codes, labels = small_net()
    loss = lambda: -net.log_probabilities(codes)[np.arange(6), labels].mean()
    rng = np.random.default_rng(8)
    for name, gradient in net.gradients(codes, labels).items():
        weights = getattr(net, name).reshape(-1)
        spots = np.flatnonzero(gradient.reshape(-1))
        for i in rng.choice(spots, min(12, len(spots)), replace=False):
            was, step = weights[i], 1e-6
            weights[i] = was + step
            over = loss()
            weights[i] = was - step
            slope = (over - loss()) / (2 * step)
            weights[i] = was
            assert abs(slope - gradient.reshape(-1)[i]) < 1e-6


def test_letters():
    assert not any(map(language_id.has_letter, ["", "12 _ ! \u00bd \u00b2 \u2462 \u0301"]))
    assert all(map(language_id.has_letter, ["1a", "\u00df", "\u4e2d", "\u00aa"]))


def test_many_copies_do_not_crowd_out_a_language(spark):
    docs = [(i, "the shun and ing wor", "aa") for i in range(5000)] + [(5000 + i, f"schung keit ach {i}", "cc") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, _ = language_id.fit(df, sample_docs=20, epochs=1)
    assert langs == ["aa", "cc"]
