"""The stages against plain versions that share no code with the library, but its fixed tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from kinweave.llm import pii, quality
from kinweave.llm.bpe import default_vocabulary
from tests.llm import cases
from tests.llm.test_native import expected
from tests.llm.test_rest import brute_spans
from tests.llm.test_simhash import similar_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def js(counts, shares):
    p = [c / sum(counts) for c in counts]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, shares, strict=True)]
    return math.sqrt(max(kl(p, m) + kl(shares, m), 0) / 2)


def passes(text):
    n, _, _, _, again = expected(text)
    if n < 10 or 100 * again > 20 * n:
        return False
    kinds = Counter("lower" if "a" <= c <= "z" else "space" if c in " \t\n\x0b\f\r" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "symbol" if c in "#*$%&|<>" else "wide" if c > "\x7f" else "other" for c in text)
    chars = min(js([kinds[k] for k in quality.CLASSES], shares) for shares in quality.CHARACTERS.values())
    words = Counter(w if w in quality.VOCABULARY else w[0].lower() + w[1:] for w in WORD.findall(text) if w in quality.VOCABULARY or (w[0].lower() + w[1:] in quality.VOCABULARY and w == w.capitalize()))
    counts = [*[words[w] for w in quality.VOCABULARY], n - sum(words.values())]
    far = []
    for common in quality.COMMON.values():
        shares = [common.get(w, 0) / 100 for w in quality.VOCABULARY]
        far.append(js(counts, [*shares, 1 - sum(shares)]))
    long, wordy = len(text) >= 150, n >= 30
    return not ((long and chars > 0.3) or (wordy and min(far) > 0.7) or (long and wordy and chars > 0.17 and min(far) > 0.25))


def without_personal_data(text):
    """The base spans' text replaced; None where the text is disguised in some way that this plain version doesn't read."""
    if pii.normalise(text).text != text:
        return None
    out, end = "", 0
    for kind, a, b in brute_spans(text):
        if a >= end:
            out += text[end:a] + f"<{kind.upper()}>"
        end = max(end, b)
    return out + text[end:]


def mixed_words(rows):
    """How many words of each (doc_id, text, source) the mix takes: blocks dealt one by one."""
    sizes = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    of = defaultdict(list)
    for d, _, s in rows:
        of[s].append(d)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    size = {s: sum(sizes[d] for d in of[s]) for s in order}
    weight, target, full = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        shared = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / shared for s in order}
        over = {s for s in order if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    blocks = Counter()
    for _ in range(round(sum(target.values()) / 16)):
        blocks[max(order, key=lambda s: target[s] / (2 * blocks[s] + 1))] += 1
    taken = {}
    for s in order:
        quota = min(16 * blocks[s], 2 * size[s])
        times, rest = divmod(quota, size[s]) if size[s] else (0, 0)
        for d in sorted(of[s], key=lambda d: (hashlib.md5(f"1:{d}".encode()).hexdigest(), d)):
            taken[d] = times * sizes[d] + min(rest, sizes[d])
            rest -= min(rest, sizes[d])
    return taken


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q, d, p, m, e = (f for _, f in corpus_pipeline.STAGES)
    given = docs.collect()
    good = corpus_pipeline.cut_table(q(spark, docs, sf_dir))
    rows = sorted(good.collect())
    assert rows == sorted(r for r in given if passes(r.text or "")) and 0 < len(rows) < len(given)
    alone = corpus_pipeline.cut_table(d(spark, good, sf_dir))
    kept = set(alone.collect())
    assert kept == {rows[i] for i in set(similar_groups([r.text for r in rows]))} < set(rows)
    clean = corpus_pipeline.cut_table(p(spark, alone, sf_dir))
    before, plain = {r.doc_id: r for r in kept}, 0
    for r in clean.collect():
        old = before[r.doc_id]
        want = without_personal_data(old.text)
        plain += want is not None
        assert r.text == (pii.redacted(old.text) if want is None else want) and r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
    assert plain > 0.9 * len(kept) and clean.count() == len(kept)
    mixed = corpus_pipeline.cut_table(m(spark, clean, sf_dir))
    texts = {r.doc_id: r.text for r in clean.collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text == texts[r.doc_id] or WORD.findall(texts[r.doc_id])[: len(r.text.split(" "))] == r.text.split(" ")
    assert words == {k: n for k, n in mixed_words([(r.doc_id, r.text, r.source) for r in clean.collect()]).items() if n}
    assert all(x.columns == docs.columns for x in (good, alone, clean, mixed))
    tk = Tokenizer.from_file(default_vocabulary())
    want = Counter()
    for r in mixed.collect():
        ids = tk.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in e(spark, mixed, sf_dir).collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_long_white_space(spark):
    """A text of two million white characters between words goes through all stages, and its ids are the library's."""
    from tokenizers import Tokenizer

    prose = "the cat of the house and the dog that was in it went to a hill for the sun with a friend on some day as it is"
    docs = spark.createDataFrame([(1, prose + " \n" * 1_000_000 + prose[::-1], "en", "a", 1), (2, prose, "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    tk, whole = Tokenizer.from_file(default_vocabulary()), {}
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        docs = corpus_pipeline.cut_table(stage(spark, docs, ""))
        if at == 2:
            whole = Counter((r.doc_id, len(tk.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == whole and whole


def test_edges(spark):
    for docs in (cases.docs(spark), cases.empty(spark)):
        columns = docs.columns
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.cut_table(stage(spark, docs, ""))
            if at < 4:
                assert docs.columns == columns
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
