"""The toxicity network's fast inference beside its training pass, and beside a word-by-word loop over every window."""

import math

import numpy as np
import pytest

pytest.importorskip("shroudline.llm")

from shroudline.llm import toxicity as X  # noqa: E402


@pytest.fixture(scope="module")
def net():
    vocabulary = {w: i + 1 for i, w in enumerate(["good", "bad", "word", "é"])}
    made = X.Network(vocabulary)
    r = np.random.default_rng(3)
    for name, value in made.p.items():
        made.p[name] = (value + r.standard_normal(value.shape) * 0.2).astype(np.float32)
    return made


def words(n, seed):
    r = np.random.default_rng(seed)
    return [str(w) for w in r.choice(["good", "bad", "word", "é", "unseen", "(bad)", "x,", "***"], n)]


def plain_window(net, chunks):
    """Attention over both directions' states, one number at a time."""
    p, h = net.p, X.HIDDEN
    vectors = net.vectors([X.bare(c) for c in chunks]).astype(float) if chunks else []
    states = []
    for d in "fb":
        state, out = np.zeros(h), {}
        # the padded window: places behind the last word have no input but their states go on
        for t in range(X.WINDOW) if d == "f" else range(X.WINDOW - 1, -1, -1):
            x = vectors[t] if t < len(chunks) else np.zeros(X.WORD_SIZE + X.CHAR_SIZE)
            a, g = x @ p[f"W{d}"] + p[f"b{d}"], state @ p[f"U{d}"]
            new = np.zeros(h)
            for j in range(h):
                z = 1 / (1 + math.exp(-(a[j] + g[j])))
                r = 1 / (1 + math.exp(-(a[h + j] + g[h + j])))
                candidate = math.tanh(a[2 * h + j] + r * g[2 * h + j])
                new[j] = (1 - z) * candidate + z * state[j]
            state = new
            out[t] = state
        states.append(out)
    if not chunks:
        return float(p["c"][0])
    both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(chunks))]
    weight = [math.exp(float(s @ p["v"])) for s in both]
    return sum(w * float(s @ p["u"]) for w, s in zip(weight, both, strict=True)) / sum(weight) + float(p["c"][0])


def plain_text(net, text):
    chunks = X.words_of(text)
    starts = [0]
    while starts[-1] + X.WINDOW < len(chunks):
        starts.append(starts[-1] + X.STRIDE)
    return max(plain_window(net, chunks[s : s + X.WINDOW]) for s in starts)


def test_inference_equals_the_training_pass(net):
    chunks = words(200, 1)
    known = {w: i for i, w in enumerate(dict.fromkeys(chunks), 1)}
    _, start, end = X.spans(np.array([150, 1, 0, 33, 16]))
    rows = X.placed(np.array([known[w] for w in chunks]), start, end, 0)
    bare = [X.bare(w) for w in known]
    table = np.concatenate([np.concatenate([net.p["bf"], net.p["bb"]])[None], net.products(bare)])
    vectors = np.concatenate([np.zeros((1, X.WORD_SIZE + X.CHAR_SIZE), np.float32), net.vectors(bare)])
    logits, _ = net.forward(vectors[rows.T], rows.T > 0)
    got = net.window_logits(table, rows)
    assert np.allclose(got, logits, atol=1e-4)


def test_scores_equal_a_plain_loop(net):
    texts = ["", "   ", "bad", " ".join(words(31, 2)), " ".join(words(32, 3)), " ".join(words(33, 4)), " ".join(words(57, 5)), "\n".join(words(700, 6))]
    got = X.Scorer(net).logits(texts)
    assert np.allclose(got, [plain_text(net, t) for t in texts], atol=1e-4)


def test_a_toxic_passage_counts_wherever_it_stands(net):
    """Every window of a very long text is scored: the score does not depend on where the highest one stands."""
    bad = " ".join(words(32, 9))
    filler = ["good"] * 30_000
    alone = max(plain_window(net, X.words_of(bad)), plain_window(net, ["good"] * 32))
    for at in (0, 12_000, 29_976):
        text = " ".join([*filler[: at // X.STRIDE * X.STRIDE], bad, *filler])
        assert X.Scorer(net).logits([text])[0] >= alone - 1e-4


def test_memory_that_is_full_changes_nothing(net, monkeypatch):
    texts = [" ".join(words(60, s)) + f" only{s}" for s in range(30)]
    want = X.Scorer(net).logits(texts)
    monkeypatch.setattr(X, "REMEMBERED", 3)
    small = X.Scorer(net)
    assert np.allclose(np.concatenate([small.logits([t]) for t in texts]), want, atol=1e-5)
