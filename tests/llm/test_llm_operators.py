"""Each operator against a plain brute-force version on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from scarp.llm import jaccard, language, mixing, pieces, pii, quality, secrets, toxicity, vectors, webtext
from scarp.llm.graph import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, extra string"


def words(rng, n, base="abcdefgh"):
    return ["".join(rng.choice(base) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(0, 120))) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split()
        for k in (1, 3, 9):
            v = list(w)
            for _ in range(min(k, len(v))):
                v[rng.randrange(len(v))] = "zz%d" % rng.randint(0, 9)
            near.append(" ".join(v))
    return [*base, *near, base[0], base[0].upper(), "", None, " \n\t ", "one two", "ONE two", "a b c d e", "x " * 5000, "\n".join(["same line here"] * 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7)] + [(1000, k) for k in range(1001, 1050)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[160] == 100 and got[9] == 5 and got[7] == 5 and got[1049] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked_by_hand(rows):
    label = {i: i for i, _ in rows if i is not None}
    s = [(i, sets_of(t)) for i, t in rows if i is not None and sets_of(t)]
    changed = True
    while changed:
        changed = False
        for i, x in s:
            for j, y in s:
                if i < j and 100 * len(x & y) >= 75 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_jaccard(spark, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    got = jaccard.linked(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    label = linked_by_hand(rows)
    by_id = dict(rows)
    for r in got:
        assert r.component_id == (label[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles == len(sets_of(by_id[r.doc_id]))
    kept = jaccard.representatives(frame(spark, [r for r in rows if r[0] is not None]))
    assert {r.doc_id for r in kept.collect()} == {i for i, c in label.items() if i == c} and "extra" in kept.columns
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_jaccard_plans_agree(spark, texts, monkeypatch):
    """Texts laid out by id, and lists cut into tiles of few rows, give the same result."""
    rng = random.Random(12)
    common = words(rng, 40, "stuvw")
    rows = list(enumerate(texts)) + [(500 + i, " ".join(common + words(rng, 11))) for i in range(60)]
    docs = frame(spark, rows)
    label = linked_by_hand(rows)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    got = {r.doc_id: r.component_id for r in jaccard.linked(docs, rounds=1, most_ids=0).collect()}
    assert got == label
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scarp_")]


def test_jaccard_bridges_a_large_group(spark):
    """A chain in which only neighbours link, and a group with more members than any bucket looks at."""
    rng = random.Random(2)
    w = words(rng, 100, "abcdefghijklmnop")
    rows, doc = [], list(w)
    for i in range(40):
        rows.append((i, " ".join(doc)))
        doc[(i * 7) % 100] = f"new{i}"
    for i in range(100, 160):
        v = list(w[::-1])
        v[rng.randrange(100)] = f"other{i}"
        rows.append((i, " ".join(v)))
    got = {r.doc_id: r.component_id for r in jaccard.linked(frame(spark, rows)).collect()}
    assert got == linked_by_hand(rows)


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(0, 60))), None, rng.choice(["b", "a", None, "tiny" if i < 3 else "a"])) for i in range(600)] + [(7, "x y", None, "a"), (None, "p q", None, "b"), (8, None, None, "a")]
    got = mixing.mix(frame(spark, rows), bucket_rows=64).collect()
    again = mixing.mix(frame(spark, rows[::-1]), bucket_rows=64).collect()
    key = lambda r: (r.source or "", r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            want.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            want[s] = 3.0 * size[s]
        left -= sum(3.0 * size[s] for s in over)
        free -= over
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])
    docs = frame(spark, rows)
    copied = mixing.copies(docs, mixing.mix(docs, bucket_rows=64))
    assert copied.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in copied.collect()) == sum(taken.values())
    assert mixing.mix(frame(spark, [])).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [float(rng.randint(1, 900)) for _ in range(500)]
    p = [0.37] * 500
    left = mixing.flight(sizes, p, rng)
    assert len(left) <= 2 and all(p[i] in (0, 1) for i in range(500) if i not in left)
    assert sum(p) == pytest.approx(185) and sum(a * b for a, b in zip(sizes, p)) == pytest.approx(0.37 * sum(sizes))


def test_quality(spark, texts):
    rows = [(i, t, None, ["h", None, "g"][i % 3]) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"a common line that all share\nown words {i} " + " ".join(words(random.Random(i), 30)), None, "big") for i in range(60)]
    rows += [(2000 + i, "a common line that all share\nA  common LINE that all share\nfew other words here", None, "big") for i in range(2)] + [rows[-1]]
    from pyspark.sql import functions as F

    docs = frame(spark, rows).withColumn("host", F.col("source"))
    got = {(r.doc_id, r.text_hash): r for r in quality.judge(docs).collect()}
    assert quality.judge(docs).count() == len(rows)
    by_id = {r.doc_id: r for r in got.values()}
    for i, t, _, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(t.count(x) for x in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert by_id[1000].n_removed == 0 and by_id[1001].n_removed == 6 and by_id[1001].kept
    assert not by_id[2000].kept and not by_id[2000].base_failed and by_id[2000].n_removed == 12
    kept = quality.accepted(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(by_id[r[0]].kept for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def luhn(s):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0


def personal(text):
    found = []
    for k, (name, p) in enumerate(
        [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    ):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and max(map(int, m[0].split("."))) > 255 or name == "card" and not (14 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 10 <= len(d) <= 15:
                continue
            found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "q%+w@e-f.g.h", "a@b.c_d@e.f", "..@x.y", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "41111111111111111", "+1 (555) 123-4567", "+1", "++12345678901", "é", "字", " ", "\n", "word", ".", "-", "0.0.0.0", "00255.1.1.001", "", "", "5500005555555559"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(400, None), (401, "1 " * 20000), (402, "a@" + "b." * 20000 + "c"), (403, "x" * 50000 + " a@b.cc"), (404, "1.2.3.4 " * 1500)]
    rows += [(500 + i, f"reach agent at 1.2.3.{i} now") for i in range(20)] + [(600, "reach agent at ZX1234567"), (None, "agent at 1.2.3.9")]
    got = pii.detect(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        want = personal(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text[:80], want[:200], r.spans[:200])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k in ("email", "ip", "card", "phone"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("context")] == [x for x in want.split(",") if x]
    assert next(r for r in got if r.doc_id == 600).spans == "context:15:24"
    assert pii.detect(frame(spark, [])).count() == 0


def test_secrets(spark):
    rng = random.Random(6)
    random_key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    cases = ['token = "0123456789abcdef0123456789abcdef"', "API_KEY:abc", "apikey=abcdef", "passwd = 'a/b+c='", "AKIA" + "A" * 20, "AKIAABC", "f" * 24, "f" * 23, "F" * 30, "ſecret=abcdef1", f"auth bearer {random_key} end", f"plain words {random_key} end", "", None]
    rows = [(i, f"é {t}" if t else t) for i, t in enumerate(cases)] + [(100 + i, f"{'abcdefghijkl'[i] * 5} secret item build_number_2024_release is {i}") for i in range(12)]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in s) for k in range(3))
    assert got[10].n_novel == 1 and got[11].n_novel == 0 and got[105].n_novel == 0
    masked = secrets.scan(frame(spark, rows), mask="[X]").collect()
    assert len(masked) == len(rows) and next(r.text for r in masked if r.doc_id == 0) == 'é [X]"' and next(r for r in masked if r.doc_id == 13).text is None
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_of_names_without_spaces(spark):
    rng = random.Random(16)
    secret = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(7)]
    names = ["aws_secret_access_key=", "private_key=", "auth=", "db.private-key=", "private_key = ", "A=1;client_credential="]
    rows = [(i, f"set {n}{secret[i]}== now") for i, n in enumerate(names)]
    rows += [(20, "auth=qWzRtYxIoPaSdFgHjKlZxCv now"), (21, "auth=SomeLongProviderNameOfAccess now"), (22, "auth=some/long/path/of/words now"), (23, f"size={secret[6]} now")]
    got = {r.doc_id: r.spans for r in secrets.scan(frame(spark, rows)).collect()}
    for i, n in enumerate(names):
        assert got[i] == f"novel:{4 + len(n)}:{4 + len(n) + 26}"
    assert got[20] == "novel:5:28" and got[21] == got[22] == got[23] == ""
    masked = {r.doc_id: r.text for r in secrets.scan(frame(spark, rows), mask="[X]").collect()}
    assert masked[1] == "set private_key=[X] now"


def test_secrets_that_leaked_often(spark):
    rng = random.Random(17)
    key, other, head, *tails = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (32, 32, 256, *[40] * 8))
    before = ["".join(rng.choice("ghijklm") for _ in range(12)) for _ in range(30)]
    rows = [(i, f"{before[i]} auth bearer {key} end") for i in range(9)] + [(20 + i, f"{before[i]} plain {head}{tails[i]} end") for i in range(7)]
    rows += [(40, f"auth bearer {head}{tails[7]} end"), (41, f"auth bearer {other} end")] + [(50 + i, f"{before[i]} plain {other} end") for i in range(6)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.n_novel for r in secrets.scan(docs).collect()}
    assert all(got[i] == 1 for i in range(9))
    assert got[40] == 1 and got[41] == 0
    assert next(r.n_novel for r in secrets.scan(docs, min_share=0.5).collect() if r.doc_id == 41) == 1


def test_language(spark):
    rng = random.Random(7)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join(words(rng, 40, kinds[k])), k) for i in range(300) for k in [rng.choice(list(kinds))]]
    rows += [(1000, None, "aa"), (1001, "123 %%", "bb"), (1002, "abcd " * 30 + "fghi " * 10, None), (None, "klmn klmno", "cc"), (1003, "", None)]
    got = language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == k for i, _, k in rows[:300]) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3
    assert by_id[1002].lang_pred == "aa" and "bb:" in by_id[1002].mixture and 0.6 < by_id[1002].score < 0.9
    assert {r.lang_pred for r in language.identify(frame(spark, [(1, "abc")])).collect()} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["vilebad", "vilemore", "awful"]
    rows, labels = [], []
    for i in range(400):
        w, toxic = words(rng, 60), int(i % 5 == 0)
        if toxic:
            for k in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (None, "awful vilebad awful"), (902, "Awful vileother awful here")]
    labels += [(None, 1), (3, None)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(frame(spark, rows), table).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    right = [by_id[i].predicted == t for i, t in labels if i is not None and t is not None and by_id[i].held_out]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert by_id[902].predicted == 1 and by_id[902].offsets.startswith("0:5,") and by_id[901].predicted == 0 and by_id[900].score == by_id[901].score
    assert {r.score for r in toxicity.score(frame(spark, rows[:5]), table.limit(0)).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), table).count() == 0


def test_chain_is_exact():
    """Marginals against the sum over all tag sequences."""
    import itertools
    import math

    chain = toxicity.Chain([-2.0, 0.5, 1.0, 1.5, 3.0], 0.7)
    kinds = [0, 2, 0, 0, 4, 1, 0]
    total, each = 0.0, [0.0] * 7
    for tags in itertools.product((0, 1), repeat=7):
        v = math.exp(sum(chain.w[k] for k, t in zip(kinds, tags) if t) + chain.a * sum(a and b for a, b in zip(tags, tags[1:])))
        total += v
        for i, t in enumerate(tags):
            each[i] += v * t
    got = chain.marginals(7, [(i, k) for i, k in enumerate(kinds) if k])
    assert got == pytest.approx([each[i] / total for i, k in enumerate(kinds) if k])


def test_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, None), (703, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (704, [1.0, 2.0]), (None, [9.0] * 6)] + [(1000 + i, rows[0][1]) for i in range(120)]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, np.floor(1024 * np.array(v + [0.0] * (6 - len(v))))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for i, q in fine:
        if i % 100 == 0:
            best = sorted((-int(q @ x), j) for j, x in fine if j != i)[:10]
            assert sorted(got.pop(i)) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert not got
    assert vectors.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_discard_blocks_of_clusters(spark):
    rng = np.random.default_rng(19)
    centres = rng.normal(size=(12, 8)) * 5
    rows = [(i, [float(x) for x in centres[i % 12] * (1 + 0.1 * (i % 3)) + rng.normal(size=8) * 0.05]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = np.floor(1024 * np.array([v for _, v in rows]))
    got = {}
    for r in vectors.nearest(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 3000, 100):
        scores = fine @ fine[q]
        best = sorted((-int(s), j) for j, s in enumerate(scores) if j != q)[:10]
        assert [got[q][k + 1] for k in range(10)] == [(j, -s) for s, j in best]
    counts = vectors.discarded(table).first()
    assert counts.compared + counts.passed < 30 * 48 and counts.compared < 30 * 20
    lists = [rng.integers(-9, 9, size=(n, 4)).astype(float) for n in (700, 5000)]
    out, compared, passed = vectors.solved(np.arange(700), lists[0], np.full(700, -np.inf), lists[1], np.arange(5000), 5)
    assert len(out) == 3500 and compared + passed == 700 * 5


def test_webtext(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-banner">Accept all.</div>
    <article><h1>Head &amp; line</h1><p>One  <b>two</b>
    three.<p>Four<br>five &lt;six&gt;</p><div class="comments"><p>Nice one, thanks.</p></div><script>var a="<p>no</p>";</script><p>End.</p></article><aside>side</aside><form>Name</form><footer>&copy; x</footer></body></html>"""
    plain = "<div id=main><p>A long paragraph, with a comma, and more text to count.</p><p>Another long paragraph; it ends here.</p></div><div class='sidebar'><a href=x>Link</a></div>"
    rows = [(1, "u", page), (2, None, plain), (3, "u", None), (4, "u", ""), (None, "u", "just text"), (5, "u", "<div " * 500), (6, "u", "<p>" * 3000 + "deep, text.")]
    got = {r.page_id: r for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nOne two three.\nFour\nfive <six>\nEnd." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "A long paragraph, with a comma, and more text to count.\nAnother long paragraph; it ends here."
    assert got[3].text == got[4].text == "" and got[None].text == "just text" and got[6].text == "deep, text."
    assert webtext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_webtext_score_decides_beside_articles(spark):
    body = [f"Sentence {k} of the body, which is long enough to count; it goes on, and it ends here." for k in range(6)]
    inside = "".join(f"<p>{x}</p>" for x in body)
    cards = "".join(f"<article><h2><a href=/{k}>Teaser {k}</a></h2></article>" for k in range(4))
    references = [f"Author {k}, A long title of a reference, 2019." for k in range(3)]
    listed = "".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(references))
    rows = [(1, "u", f"<body><div id=text>{inside}</div>{cards}</body>"), (2, "u", f"<body><article>{inside}<ol>{listed}</ol></article></body>")]
    rows.append((3, "u", f"<body><div class=lead><p>{body[0]} {body[1]}</p></div><article>{inside}</article><ul>{listed}</ul></body>"))
    got = {r.page_id: r.text.split("\n") for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == body
    assert got[2] == body + references
    assert got[3] == [f"{body[0]} {body[1]}", *body]


def test_webtext_noise_names(spark):
    body = [f"Sentence {k} of the body, which is long enough to count; it goes on, and it ends here." for k in range(4)]
    inside = "".join(f"<p>{x}</p>" for x in body)
    pages = [
        f'<div class="page no-sidebar"><article>{inside}</article></div>',
        f'<div class="layout has-sidebar"><div>{inside}</div></div>',
        f'<div id="search-page"><main>{inside}</main></div>',
        f"<nav>{'<div>' * 100}menu</nav><article>{inside}</article>",
        f"<article>{inside}<figure><img src=x><figcaption>A caption.</figcaption></figure></article>",
        f'<article>{inside}</article><div class="post-comments"><article class="comment"><p>{body[0]}</p></article></div><aside><article><p>{body[0]}</p></article></aside>',
        f'<main>{inside}<div class="comments"><article><p>{body[0]}</p></article></div><div class="cookie-banner main"><p>{body[0]}</p></div></main>',
    ]
    got = {r.page_id: r.text.split("\n") for r in webtext.extract(spark.createDataFrame([(k, "u", x) for k, x in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert got == {k: [*body, "A caption."] if k == 4 else body for k in range(len(pages))}


def test_pieces(spark, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(10)
    more = ["".join(rng.choice("abcdetionrs  \n\té字😀_-.12") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    rows = list(enumerate([*texts, *more, " lead", "trail ", "a▁b", "  ", "x" * 20000])) + [(None, "null id")]
    encoded = pieces.encode(frame(spark, rows), MODEL)
    for r in encoded.collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == model.encode(text) and r.n_tokens == len(r.ids) and r.decoded_ok
    back = {r.doc_id: r.text for r in pieces.decode(encoded, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert pieces.encode(frame(spark, []), MODEL).count() == 0


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    v = pieces.Vocabulary(MODEL)
    ids, _ = pieces.Encoder(v).encode([" " * 100_000 + "end"])
    assert pieces.decoded(ids.tolist(), v.text) == " " * 100_000 + "end"
    text = "token = abcdef0123456789abcd " * 20_000
    base = secrets.base_spans(text)
    assert len(base) == 20_000 and not secrets.novel_spans(text, base, None, 16, 0.5)
    blocks = webtext.Page("<b>" * 20_000 + "<p>x</p>" * 20_000 + "<div>" * 20_000 + "deep").blocks
    assert len(blocks) == 20_001 and len({b[1] for b in blocks}) == 2
    assert time.time() - began < 10


def test_long_text_is_encoded_in_parts(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    text = "some words,  and runs   of spaces " * 30 + "x" * 200 + "  end"
    ids, ends = pieces.Encoder(pieces.Vocabulary(MODEL)).encode([text])
    assert ids.tolist() == model.encode(text) and ends.tolist() == [len(ids)]


def test_many_numbers(spark):
    import time

    text = "12 1.2.3.4 " * 25_000 + "1" * 50_000
    began = time.time()
    r = pii.detect(frame(spark, [(1, text)])).first()
    assert r.n_ip == 25_000 and r.spans.startswith("ip:3:10,ip:14:21,") and time.time() - began < 60


def test_bootstrapped_contexts(spark):
    local = [f"555-{k:04d}" for k in range(12)]
    rows = [(i, f"then call me {f'+1 555 123 45{i:02d}'} today") for i in range(20)] + [(100 + i, f"then call me {x} today") for i, x in enumerate(local)]
    rows += [(200 + i, f"as of {1990 + i}-01 we {'saw page' if i % 2 else 'left room'} 12{i:03d} here") for i in range(40)]
    rows += [(300 + i, f"please message user{i:03d}x today") for i in range(3)] + [(400, "then call me jdoe42 today")]
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, rows)).collect()}
    assert all(got[100 + i] == f"context:13:{13 + len(x)}" for i, x in enumerate(local)) and got[400] == "context:13:19"
    assert all(got[i].startswith("phone:") and "context" not in got[i] for i in range(20))
    assert not any(got[i] for i in [*range(200, 240), 300, 301, 302])


def test_clashing_names(spark):
    """Tables whose other columns have names that operators use inside."""
    names = ["row", "id", "k", "gone", "own", "times", "_id", "_k", "h", "t", "_size", "_copy"]
    rng = random.Random(20)
    rows = [(i, " ".join(words(rng, 30)), "s", *[str(i)] * len(names)) for i in range(30)]
    rows += [(40, rows[3][1], "s", *["40"] * len(names)), rows[5], (41, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(30), 5, 41])
    assert sorted(r.doc_id for r in quality.accepted(docs).collect()) == sorted([*range(30), 5, 40])
    mixed = mixing.copies(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns and all(r._k == str(r.doc_id) for r in mixed.collect())
    masked = secrets.scan(docs, mask="[X]")
    assert masked.columns == docs.columns and masked.count() == len(rows)


def test_repeated_rows_fly_apart(spark):
    rows = [(1, "one two three", None, "a")] * 500 + [(2, "four five", None, "b")] * 40
    mixed = mixing.mix(frame(spark, rows), bucket_rows=32).collect()
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(mixed) == 540 and all(abs(taken[s] - target[s]) <= 6 for s in "ab")


def test_unigram_walk_is_the_best_path():
    v = object.__new__(pieces.Vocabulary)
    v.kind, v.score = "unigram", {"▁a": -1.0, "b": -2.0, "ab": -2.5, "▁ab": -3.5, "bc": -1.5, "c": -3.0, "▁": -2.0, "a": -3.0}
    v.ids = {p: k for k, p in enumerate(v.score)}
    v.longest, v.bytes, v.unknown = 3, {}, 99

    def best(word):
        if not word:
            return 0.0, []
        return max((best(word[k:])[0] + v.score[word[:k]], [v.ids[word[:k]], *best(word[k:])[1]]) for k in range(1, len(word) + 1) if word[:k] in v.score)

    for word, ids in pieces.Encoder(v).walk_unigram(sorted(["▁abc", "▁ab", "▁abab", "▁acb", "▁bcbc"])):
        assert sum(v.score[p] for i in ids for p in v.ids if v.ids[p] == i) == pytest.approx(best(word)[0])
