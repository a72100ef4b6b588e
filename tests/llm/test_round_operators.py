"""Fill-in-the-middle, secret scan and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.llm import divergence, fill_middle, queries, secrets
from stagewise.llm.common import ready

DOCS = "doc_id long, text string, lang string, source string, n int, form string, spans string, term string, total int, block int"
REST = (1, "x", "y", "z", 2, 3)


@pytest.fixture()
def odd(spark):
    """NULLs in all columns, empty, very long and repeated texts, and columns named like the operators' own."""
    ready(spark)
    rows = [
        (1, "The cat, the dog é漢🤦🏼‍♂️.", "en", "a", *REST), (2, None, None, None, *[None] * 6), (3, "", "en", "a", *REST), (None, "no id at all", "en", "b", *REST),
        (4, "the long text of a document\n" * 20000, "en", "b", *REST), (1, "The cat, the dog é漢🤦🏼‍♂️.", "en", "a", *REST), (5, "holds <M> itself", "de", "b", *REST),
        (6, "<", "de", "b", *REST), (7, "Das <P Haus> S> und mehr", "de", "c", *REST),
    ]
    rows += [(i, f"wort{i} haus garten " * (i % 7), "de", f"s{i % 3}", *REST) for i in range(8, 60)]
    return spark.createDataFrame(rows, DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-the-middle


def plain_middle(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return len(text), *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_middles_of_odd_rows(odd):
    found = fill_middle.fill_in_middle(odd).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, r.back) for r in found) == texts
    want = Counter((d, *plain_middle(d, t)) for (d, t), n in texts.items() for _ in range(n))
    assert Counter(tuple(r)[:6] for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_units_are_counted_and_cut_by_ranks():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé \n\t漢🤦b") for _ in range(rng.randrange(60))) for _ in range(300)]
    data = [t.encode() for t in texts]
    lengths = np.array([len(d) for d in data])
    last = np.cumsum(lengths)
    first = last - lengths
    matrix = fill_middle.WaveletMatrix(fill_middle.classes(np.frombuffer(b"".join(data), np.uint8), first[lengths > 0]))
    plain = {"char": list, "word": lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), "line": lambda t: re.findall("[^\n]*\n|[^\n]+", t)}
    for unit, cut in plain.items():
        n = fill_middle.begun(matrix, unit, last) - fill_middle.begun(matrix, unit, first)
        assert n.tolist() == [len(cut(t)) for t in texts]
        units = np.array([rng.randint(0, k) for k in n.tolist()])
        at = fill_middle.cut(matrix, unit, first, last, units) - first
        for d, k, t, u in zip(data, at.tolist(), texts, units.tolist()):
            assert len(cut(d[:k].decode())) == u  # the cut falls between code points, with so many units before it


def test_middles_by_words_come_back_whole(odd, spark):
    for unit in ("word", "line"):
        found = fill_middle.fill_in_middle(odd, unit=unit, seed="2", plain_from=100, marks=("<[P]>", "<|s|>", "<.m.>"))
        back = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), ("<[P]>", "<|s|>", "<.m.>"))).collect()
        assert Counter((r.doc_id, r.back) for r in back) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd, unit="page")


# Secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(3)
    pieces = [
        "password", "PassWd", "token", "api_key", "apikey", "secret", " ", "=", ":", "'", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "é", "漢", ".",
        "\n", "A", "f", "7", "ghp_", "://", "u:p@", "eyJ", "ſecret", "toKen", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "a.b", "sk_live_",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return texts + ["token=token:abcdefgh", "a" * 300_000, "0" * 300_000 + "g", "http://" + "u" * 100_000 + ":p@h", "password = " + "k" * 100_000, ""]


def test_base_spans_are_those_of_the_patterns(spark, secret_texts):
    ready(spark)
    docs = spark.createDataFrame([(i, t, "k", "1") for i, t in enumerate(secret_texts)] + [(None, None, "k", "1")], "doc_id long, text string, kind string, spans string")
    kinds = [r.kind for r in secrets.BASE]
    hits = 0
    for r in secrets.scan(docs).collect():
        want = [] if r.doc_id is None else [(kinds[i], s, e) for s, i, e in base_spans(secret_texts[r.doc_id])]
        assert [tuple(x) for x in r.spans for x in [(x.kind, x.start, x.end)] if x[0] in kinds] == want
        hits += len(want)
    assert hits > 500
    assert secrets.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_each_rule_matches_like_its_pattern(rule, secret_texts):
    machines = secrets.automata((rule,))
    extra = [
        f"x ghp_{'aB3' * 12} y", "xoxb-123456789012-abcDEF", f"AIza{'x_-4' * 9} z", f"sk_live_{'0aB' * 8}", "eyJhbGci.eyJzdWIi.sig-_1 eyJa.eyJb", "see ftp://me:pw@host/x",
        "-----BEGIN PRIVATE KEY-----\nMIIE+/=\n-----END PRIVATE KEY----- -----BEGIN EC PRIVATE KEY-----\nabc",
    ]
    flags = (re.I | re.A if rule.either_case else re.A) | re.S
    pattern, keep = re.compile(rule.pattern.encode(), flags), re.compile((rule.keep or rule.pattern).encode(), flags)
    for text in secret_texts[:400] + extra:
        data = text.encode()
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(data) if keep.fullmatch(m[0])]
        assert secrets._matches(data + b"\xff", (rule,), machines) == want
    assert rule.kind in ("assign", "access", "hex") or any(pattern.search(t.encode()) for t in extra)


def test_automaton_is_minimal_and_lanes_agree_with_one_walk(secret_texts):
    machine, reads = secrets.automata(secrets.RULES)
    for m in (machine, reads):
        told = m.accepts.copy()
        for _ in range(60):  # states that are told apart after ever longer texts
            told = np.unique(np.column_stack([told, told[m.next]]), axis=0, return_inverse=True)[1].reshape(-1)
        assert told.max() + 1 == len(m.next)
    data = machine.classes[np.frombuffer("\n".join(secret_texts[:600]).encode(), np.uint8)]
    state, want = 0, []
    for c in data.tolist():
        state = machine.next[state, c]
        want.append(state)
    assert secrets.walked(machine, data).tolist() == want


def test_secret_query_digests(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kinds = [r.kind for r in secrets.BASE]
    for r in queries.QUERIES["op12_automaton_secrets"](spark, folder).collect():
        want = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(i == k for _, i, _ in want) for k in range(3))
        assert r.base_sha256 == sha(",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in want))


# Source divergence


def plain_divergence(rows):
    words = {i: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for i, r in enumerate(rows)}
    groups, df, n = set(), Counter(), defaultdict(Counter)
    for i, r in enumerate(rows):
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        df.update({(lang, w) for w in words[i]})
        n[lang, source].update(words[i])
        n[lang].update(words[i])
    found = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in df.items() if x == lang and k >= 10]
        sources = [s for x, s in groups if x == lang]

        def p(of):
            total = sum(n[of][w] for w in kept)
            return {w: 1 + 10**9 * (n[of][w] + 2) // (total + 2 * len(kept)) for w in kept}

        shares, q = {s: p((lang, s)) for s in sources}, p(lang)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(shares[s][w], q[w]), w.encode()) for w in kept if n[lang, s][w] and shares[s][w] > q[w])[:10]
            for part, best in (("pair", pairs), ("term", terms)):
                found |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(best, 1)}
    return found


@pytest.mark.parametrize("block, sources", [(2048, 128), (3, 2)])
def test_divergence_of_odd_rows(odd, block, sources, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rows = odd.collect()
    found = [tuple(r) for r in divergence.divergence(odd).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows)
    assert ("", "", "pair") not in {f[:3] for f in found}
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_divergence_of_documents(spark, monkeypatch):
    ready(spark)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(divergence, "SOURCES", 4)
    monkeypatch.setattr(divergence, "HELD", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {tuple(r) for r in divergence.divergence(docs).collect()} == plain_divergence(docs.collect())


def test_trees_share_equal_subtrees_and_meet_each_pair_once():
    rng = np.random.default_rng(1)
    counts = np.where(rng.random((6, 1000)) < 0.05, rng.integers(1, 4, (6, 1000)), 0)
    counts[5] = counts[4]
    trees = divergence.Trees(counts)
    assert trees.roots[4] == trees.roots[5] and len(set(trees.roots.tolist())) == 5
    for left, right in trees.children:
        assert len(set(zip(left.tolist(), right.tolist()))) == len(left)
    for a in range(6):
        for b in range(6):
            x, y, times = trees.met(a, b)
            want = Counter(zip(counts[a].tolist(), counts[b].tolist()))
            assert {k: v for k, v in zip(zip(trees.leaves[x].tolist(), trees.leaves[y].tolist()), times.tolist()) if v} == want


def test_shares_are_exact_for_large_counts():
    for n, total, terms in ((0, 0, 0), (0, 10, 3), (10**12, 4 * 10**15, 10**8), (10, 10, 1)):
        want = 1 + 10**9 * (n + 2) // max(total + 2 * terms, 1) if terms else None
        if want:
            assert divergence.shares(np.array([n]), total, terms).tolist() == [want]
