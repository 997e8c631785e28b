"""Each operator against a brute-force version, with odd rows."""

import hashlib
import math
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import langid, toxicity
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.license_sentences import EXCEPTION_SENTENCES, SENTENCES
from graphloom.llm.license_signatures import BODIES, EXCEPTIONS, NAMES, NOTICES
from graphloom.llm.license_scan import BASE, Found, Pattern, detect, license_scan, rules, suppressed, _compiled, _normal
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.quality import quality
from graphloom.llm.simhash import fingerprint, forest, near_pairs, simhash_groups, _masks, _refined
from graphloom.llm.url_filter import bloom_filter, canonical, url_filter

DOCS = "doc_id bigint, text string"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCAB = "the of and Ünder Éte river stone a b c x1 2y".split()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def random_text(rng, n, sep=" "):
    return sep.join(rng.choice(VOCAB, n))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# decontamination


def brute_hits(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        n = min(size, len(iw))
        windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else ()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(i)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate_like_brute_force(spark, block):
    rng = np.random.default_rng(0)
    items = [(1, random_text(rng, 25)), (20, random_text(rng, 10)), (3, "River stone"), (4, ""), (5, None), (None, "b c x1 2y b"), (7, "solo"), (20, random_text(rng, 12))]
    docs = [(i, random_text(rng, 60, ", ")) for i in range(25)]
    docs += [(90, items[0][1].upper()), (91, "x " + items[1][1] + "\x00y " + items[1][1]), (92, None), (93, ""), (90, "a solo"), (90, "a solo"), (None, "SOLO"), (94, items[0][1][5:] + " b" * 3000)]
    rows = frame(spark, docs).withColumns({"items": F.lit("clash"), "words": F.lit(1), "n_hit": F.lit("c"), "uid": F.lit(2)})
    out = decontaminate(rows, frame(spark, items, "item_id bigint, text string").withColumn("words", F.lit(0)), block=block).collect()
    got = sorted((r.doc_id or -1, r.text or "", r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out)
    want = []
    for d, t in docs:
        n, h, found = brute_hits(t, items)
        want.append((d or -1, t or "", n, h, tuple(found), h > 0))
    assert got == sorted(want)


def test_decontaminate_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [(1, "q"), (2, None)], "item_id bigint, text string")
    assert decontaminate(docs, items.limit(0)).first().contaminated is False
    assert decontaminate(docs, items.where("text IS NULL")).first().n_hit == 0
    assert decontaminate(docs.limit(0), items).count() == 0


# URL filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://net", "https://www.example.net/en/a?b=1#c", "http://example.net/fr/", "x://example.com/de/1", "HTTP://Sub.Org/fr/", "http://notnet.com/", "http://h/p://q/r"]
    urls += ["http://spam.com/a", "https://www.spam.com/a/?utm_source=x#f", "https://m.spam.com:80/a/index.html", "http://spam.com/a?id=1&ref=2", "http://spam.com/b", None, "http://spam.com/a"]
    long = "http://spam.com/" + "a/" * 100_000 + "?" + "&".join(f"k{i}=1" for i in range(3000))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit("c"), "key": F.lit(1), "verdict": F.lit("c")})
    listed = spark.createDataFrame([("http://spam.com/a",), (None,), ("junk",), ("http://spam.com/a?id=1",)], "url string")
    rules_ = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for blocks in (0, 1, 1 << 20):
        rows = sorted(url_filter(pages, rules_, listed, max_blocks=blocks).collect(), key=lambda r: r.page_id)
        got = [(r.host, r.path, r.rule, r.verdict) for r in rows]
        assert got[:11] == [
            ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/x", "net/", "block"), ("net", "", None, "allow"),
            ("www.example.net", "/en/a", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
            ("sub.org", "/fr/", "org/fr/", "allow"), ("notnet.com", "/", None, "allow"), ("h", "/p://q/r", None, "allow"),
        ]
        assert [v for *_, v in got[11:]] == ["block", "block", "block", "block", "allow", "allow", "block"]
    longer = spark.createDataFrame([(1, long), (2, long + "&x=2"), (3, long.replace("http://", "HTTPS://www.") + "#top")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter(longer, rules_, longer.where("page_id = 1").select("url")).collect()} == {1: "block", 2: "allow", 3: "block"}
    many = [("block", f"h{i}.com", "/a/") for i in range(3000)] + [("allow", "x.h7.com", "/"), ("block", "h7.com", "/"), ("allow", "h7.com", "/")]
    sites = spark.createDataFrame([(1, "http://q.h2999.com/a/b"), (2, "http://x.h7.com/a/"), (3, "http://x.h7.com/b"), (4, "http://h7.com/"), (5, "http://h2999.com/b")], "page_id bigint, url string")
    assert {r.page_id: r.rule for r in url_filter(sites, many, listed.limit(0)).collect()} == {1: "h2999.com/a/", 2: "x.h7.com/", 3: "x.h7.com/", 4: "h7.com/", 5: None}
    assert url_filter(pages.limit(0), rules_, listed).count() == 0 and url_filter(pages, rules_, listed.limit(0)).where("verdict = 'block'").count() == 3


def test_bloom_filter_has_no_false_negatives(spark):
    urls = spark.range(5000).select(canonical(F.concat(F.lit("http://h.x/"), F.col("id"))).alias("key"))
    from graphloom.llm.url_filter import passes

    filled = bloom_filter(urls, 1250)
    assert urls.where(passes(urls, filled)).count() == 5000
    others = spark.range(5000, 15000).select(F.concat(F.lit("h.x/"), F.col("id")).alias("key"))
    assert 0 < others.where(passes(others, filled)).count() < 1000
    assert urls.select(F.lit(None).cast("string").alias("key")).where(passes(urls, filled)).count() == 0


# licenses


def test_license_rules():
    assert len(rules()) > 300
    assert [f.label for f in detect(_normal("Licensed under CC BY-NC 4.0; see the GNU General Public License version 3."))] == ["cc-by-nc-4.0", "gpl-3"]
    assert detect(_normal("mit der Zeit")) == []
    inner, outer = Found("a", 2, 4, 5), Found("b", 1, 6, 9)
    assert suppressed([inner, outer]) == [outer] and suppressed([inner, outer._replace(priority=1)]) == [Found("b", 1, 6, 1), inner] and suppressed([inner, inner]) == [inner]


def plain_spans(pattern, normal):
    """Places of a pattern; of one with a gap, each head with the first tail behind it, if no other head stands between."""
    heads, *tails = ([m.span() for m in re.finditer(rf"(?<= )(?:{x.strip()})(?= )", normal)] for x in pattern.split("…"))
    if not tails:
        return heads
    first = [(h, min((t for t in tails[0] if t[0] > h[1]), default=None)) for h in heads]
    return [(h[0], t[1]) for h, t in first if t and not any(h[1] < o[1] <= t[0] for o in heads)]


def brute_found(normal):
    """All rules over the whole text, and each place held against all others."""
    spaces = [i for i, c in enumerate(normal) if c == " "]
    all_ = set()
    for r in rules():
        for a, z in plain_spans(r.pattern, normal):
            start = sum(i < a for i in spaces) - 1
            all_.add(Found(r.label, start, start + normal[a:z].count(" ") + 1, r.priority))
    stays = lambda f: not any(g.start <= f.start and f.end <= g.end and (-g.priority, g.start - g.end, g.label) < (-f.priority, f.start - f.end, f.label) for g in all_)
    return sorted((f for f in all_ if stays(f)), key=lambda f: (f.start, f.end, f.label))


def test_each_signature_finds_its_passage():
    for rows in (BODIES, EXCEPTIONS, NAMES, NOTICES):
        for label, keyword, pattern, passage in rows:
            normal = _normal(passage)
            spans = plain_spans(pattern, normal)
            assert spans and any(f" {k} " in f" {normal[spans[0][0] : spans[0][1]]} " for k in ([keyword] if isinstance(keyword, str) else keyword)), (label, passage)
            found = detect(_normal(f"Some words before. {passage} And some after."))
            assert any(f.label == label or f.priority > 1 for f in found), (label, passage, found)
            assert brute_found(normal) == detect(normal), passage
    assert len({p for rows in (BODIES, EXCEPTIONS, NAMES, NOTICES) for _, _, p, _ in rows}) > 150


def test_each_sentence_finds_itself_and_nothing_less():
    for rows in (SENTENCES, EXCEPTION_SENTENCES):
        for label, keyword, sentence in rows:
            normal = _normal(sentence)
            assert f" {keyword} " in normal, (label, keyword)
            found = detect(_normal(f"Some words before. {sentence.upper()} And some after."))
            assert any(f.label == label and f.priority > 1 for f in found), (label, sentence, found)
            w = normal.split()
            near = w[: len(w) // 2] + ["otherwise"] + w[len(w) // 2 :]  # one word more in the middle
            assert not list(Pattern(normal.strip()).spans(f" {' '.join(near)} "))
    hand = [*SENTENCES, *EXCEPTION_SENTENCES, *BODIES, *EXCEPTIONS, *NOTICES]
    assert len(hand) > 300


def test_signatures_with_gaps_of_any_length():
    for n in (1, 12, 13, 100, 5000):
        holder = " ".join(["Holder" * 9] * n)
        text = f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products"
        assert "bsd-3" in {f.label for f in detect(_normal(text))}, n
    assert "bsd-3" not in {f.label for f in detect(_normal("nor the names of its contributors may be used to endorse or promote; neither the name of"))}
    heads = "in no event shall x " * 3 + "be liable " * 2 + "in no event shall be liable"
    assert [(f.start, f.end) for f in detect(_normal(heads)) if f.label == "liability"] == [(10, 17), (19, 25)]


def test_license_labels_and_score_like_brute_force(spark):
    rng = np.random.default_rng(15)
    passages = [row[-1] for rows in (BODIES, EXCEPTIONS, NAMES, NOTICES, SENTENCES) for row in rows] + ["GPL-3.0", "SPDX-License-Identifier: MIT", "plain words of a text", "the license of the law", "CC BY-SA 4.0", "MIT License"]
    texts = [" ".join(rng.choice(passages, int(n))) for n in rng.integers(0, 8, 40)]
    for r in license_scan(frame(spark, list(enumerate(texts)))).collect():
        want = brute_found(_normal(texts[r.doc_id]))
        assert [tuple(f) for f in r.found] == [tuple(f) for f in want], texts[r.doc_id]
        assert r.labels == sorted(set(r.base_labels) | {f.label for f in want})
        best = max([0.5 + min(f.priority, 30) / 60 for f in want] + [0.5 if r.base_starts else 0.0])
        assert r.score == best


def test_megabytes_of_notices_take_seconds():
    text = " ".join(row[3] for rows in (BODIES, NOTICES) for row in rows)
    text = (text + "\n") * (5_000_000 // len(text))
    began = time.perf_counter()
    found = detect(_normal(text))
    assert time.perf_counter() - began < 20 and len(found) > 50_000


def spelled(parsed, most):
    """A text that a pattern matches, with the most or the fewest of what may be left out."""
    out = ""
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "IN":
                out += chr(x[0][1]) if str(x[0][0]) == "LITERAL" else "1"
            case "SUBPATTERN":
                out += spelled(x[3], most)
            case "BRANCH":
                out += spelled(x[1][0 if most else -1], most)
            case "MAX_REPEAT":
                out += spelled(x[2], most) * (x[1] if most else x[0])
            case "NOT_LITERAL":
                out += "x"
            case _:
                raise ValueError(op)
    return out


def test_every_license_rule_passes_the_keywords():
    automaton, numbered = _compiled()
    for i, (rule, pattern) in enumerate(numbered):
        for most in (False, True):
            text = f" {spelled(re._parser.parse(rule.pattern.replace("… ", "")), most)} "
            assert list(pattern.spans(text)) and any(i in hit for _, hit in automaton.iter(text)), (rule, text)


def test_license_ids_and_short_names():
    ids = ("MIT", "GPL-2.0-only", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "OFL-1.1", "GFDL-1.3", "ODbL-1.0", "Artistic-2.0", "Apache-2.0", "CC0-1.0")
    for spdx in ids:
        assert [f.label for f in detect(_normal(f"SPDX-License-Identifier: {spdx}"))] == [spdx.lower().removesuffix("-only")], spdx
    for text, label in (("GPLv3", "gpl-3"), ("it is GPL-3.0 code", "gpl-3.0"), ("LGPLv2.1+", "lgpl-2.1"), ("BSL-1.0", None), ("Creative Commons Zero v1.0", "cc0-1.0")):
        assert [f.label for f in detect(_normal(text))] == ([label] if label else []), text
    assert detect(_normal("mit Zlib, artistic, ISC")) == []


def test_license_scan_like_brute_force(spark):
    texts = ["", None, "CC by, cc-BY all rights reserved", "x General public  license", "All Rights Reserved " * 500, "accc by", "cc by cc by", "Été cc by"]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(0, "")]).withColumns({"labels": F.lit(1), "score": F.lit("c")})
    for r in license_scan(docs).collect():
        w = words(texts[r.doc_id])
        starts, labels = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r.n_words, r.base_starts, r.base_labels) == (len(w), sorted(starts), sorted(labels)) and labels <= set(r.labels) and 0 <= r.score <= 1
    assert license_scan(docs.limit(0)).count() == 0


# line dedup


def test_line_dedup_like_brute_force(spark):
    rng = np.random.default_rng(1)
    shared = ["Line number %d with enough letters to count as long É" % i for i in range(6)]
    docs = []
    for i in range(30):
        lines = [random_text(rng, 3) for _ in range(3)] + [("\t " + s.upper().replace("É", "É") + " \r") if rng.random() < 0.3 else s for s in rng.choice(shared, 3)]
        docs.append((int(i), "\n".join(rng.permutation(lines))))
    docs += [(40, None), (41, ""), (42, "\n\n"), (29, docs[29][1]), (None, "\n".join(shared)), (43, shared[0] + "\n" + shared[0])]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    bad = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= 5}
    want = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if bad.get(key(x), d) == d]
        want.append((d or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    rows = frame(spark, docs).withColumns({"kept": F.lit(1), "line": F.lit("c"), "drop": F.lit("c")})
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(rows).collect()) == sorted(want)
    assert line_dedup(rows.limit(0)).count() == 0 and bad


def test_line_dedup_of_long_copies_and_rows_that_share_an_id(spark):
    long = "\n".join(f"line number {i} of a long text that is copied five times" for i in range(100_000))
    docs = frame(spark, [(i, long) for i in range(5)] + [(4, "other\n" + long[:5000]), (None, long)])
    began = time.perf_counter()
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped) for r in line_dedup(docs).withColumn("n_chars", F.length("kept")).drop("text", "kept").collect())
    assert time.perf_counter() - began < 40
    n = long[:5000].count("\n") + 2
    assert rows == [(-1, 100_000, 100_000), *((i, 100_000, 100_000) for i in range(4)), (4, n, 0), (4, 100_000, 0)]


def test_line_dedup_deals_hot_and_cold_lines_alike(spark, monkeypatch):
    rng = np.random.default_rng(11)
    shared = [f"a line of at least forty characters, number {i:04d}" for i in range(30)]
    docs = frame(spark, [(i, "\n".join(["the one line that all the documents have in common", *rng.choice(shared, 4)])) for i in range(60)])
    want = sorted(map(tuple, line_dedup(docs).collect()))
    for share in (1, 10**9):
        monkeypatch.setattr("graphloom.llm.line_dedup.HOT_SHARE", share)
        assert sorted(map(tuple, line_dedup(docs).collect())) == want


# language


def test_languages(spark):
    rng = np.random.default_rng(2)
    rows = [(i, random_text(rng, 30) if i % 2 else "der die das und nicht über " * 5, "en" if i % 2 else "de") for i in range(80)]
    rows += [(200, None, "en"), (201, "123 ?!", "de"), (202, "über das", None), (203, "x" * 300_000, "en"), (1, rows[1][1], "en"), (None, "und die", "de")]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string").withColumns({"lang_pred": F.lit(1), "score": F.lit("c"), "bucket": F.lit(0)})
    out = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") < 60, per_label=20).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") and 0 <= out[i].score <= 1 for i in range(60, 80))
    assert out[200].lang_pred == out[201].lang_pred == "und" and out[202].lang_pred == "de" and out[200].score == 0
    assert len(out) == 85 and langid.identify(docs, F.lit(False)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def plain_grams(text):
    """Buckets of 1- to 3-grams, by plain integers."""
    letters = [ord(c) if c.isalpha() else 32 for c in f" {text} ".lower()]
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            h = n
            for k in range(n):
                h = (h ^ letters[i + k]) * (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k] % 2**64
            yield h >> 48


def plain_naive_bayes(rows, text, smoothing=0.5):
    """Posteriors from n-grams counted one by one."""
    grams = lambda t: list(plain_grams(t))
    counts = {}
    for lang, t in rows:
        at = counts.setdefault(lang, Counter())
        at.update(grams(t or ""))
    logs = {}
    for lang, at in counts.items():
        total = sum(at.values()) + smoothing * langid.BUCKETS
        logs[lang] = sum(math.log((at[g] + smoothing) / total) for g in grams(text))
    top = max(logs.values())
    return {lang: math.exp(x - top) / sum(math.exp(y - top) for y in logs.values()) for lang, x in logs.items()}


def test_language_scores_like_plain_naive_bayes(spark):
    rng = np.random.default_rng(12)
    learn = [(["en", "de", "fr"][i % 3], " ".join(rng.choice("the der le of und et and die les stone stein pierre".split(), 6))) for i in range(30)]
    asked = ["der stone", "Le!", "x", "und les and the", "pierre " * 3, "stein, stein", "the  et", "La", "é"]
    model = langid.train(spark.createDataFrame([(a, b) for a, b in learn], "lang string, text string"))
    want = [plain_naive_bayes(learn, t) for t in asked]
    for parts in (1, 5):
        docs = frame(spark, list(enumerate(asked))).repartition(parts)
        for r in langid.predict(docs, model).collect():
            best = max(sorted(want[r.doc_id]), key=want[r.doc_id].get)
            assert r.lang_pred == best and abs(r.score - want[r.doc_id][best]) < 1e-6, (asked[r.doc_id], r, want[r.doc_id])


def test_neighbours_and_length_do_not_change_a_score(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b"], rng.normal(-9, 1, (langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    for texts in (["La", "De.", "x", "zu viel"], ["a"], ["x"] * 7, ["", "La", ""], [random_text(rng, int(n)) for n in rng.integers(1, 60, 20)]):
        singles = np.array([langid._log_likelihood(model, t) for t in texts])
        assert np.allclose(langid._scored(model, texts), singles, rtol=1e-12, atol=1e-6)
    texts = [random_text(rng, 300) for _ in range(4)]
    short = list(langid._likelihoods(model, texts))
    monkeypatch.setattr(langid, "_step", lambda _: 1024)  # now each text is over a step long
    long = list(langid._likelihoods(model, texts))
    assert [i for i, _ in long] == [i for i, _ in short] and np.allclose([x for _, x in long], [x for _, x in short], atol=1e-4)


def test_any_number_of_languages(spark):
    rng = np.random.default_rng(8)
    learn = [(f"l{i % 450}", "".join(chr(0x400 + (i % 450 * 7 + int(k)) % 900) for k in rng.integers(0, 12, 30))) for i in range(900)]
    docs = frame(spark, [(i, t, lang) for i, (lang, t) in enumerate(learn)], "doc_id bigint, text string, lang string")
    few = learn[:40]
    asked = frame(spark, [(i, t) for i, (_, t) in enumerate(few)] + [(99, "123")])
    trained = langid.train(spark.createDataFrame(few, "lang string, text string"), block=7)
    for r in langid.predict(asked, trained).collect():
        want = plain_naive_bayes(few, few[r.doc_id][1]) if r.doc_id < 99 else {"und": 0.0}
        best = max(sorted(want), key=want.get)
        assert r.lang_pred == best and abs(r.score - want[best]) < 1e-6
    got = langid.identify(docs, F.lit(True)).where("lang_pred = lang").count()
    assert got > 700  # of 900, in 450 languages whose letters overlap


# toxicity


def test_deobfuscation():
    plain = "moron idiot stupid clown worthless the of and ring then stone".split()
    tri = {}
    for w in plain * 3:
        m = f"^^{w}$"
        for i in range(len(m) - 2):
            tri[m[i : i + 3]] = -1.0
    for hidden, word in (("m0r0n", "moron"), ("st00pid", None), ("1diot", "idiot"), ("stuuuupid", "stupid"), ("c.l.o.w.n", "clown"), ("cl0wn!", "clown")):
        if word:
            assert word in toxicity.restored(hidden, tri), hidden
    coffee = {m[i : i + 3]: -1.0 for m in ("^^coffee$",) for i in range(len(m) - 2)}
    for hidden in ("ccoffee", "cooffee", "coffeee", "c0ffee", "ccooffffeeee"):
        assert "coffee" in toxicity.restored(hidden, coffee), hidden
    assert toxicity.restored("stone", tri) == [] and toxicity.decode("moron", tri) == "moron"


def test_decoding_finds_the_best_of_all_paths():
    """Viterbi against every path through the lattice."""
    rng = np.random.default_rng(13)
    letters = "abilo"
    tri = {a + b + c: float(-rng.integers(1, 9)) for a in "^" + letters for b in "^" + letters for c in letters + "$"}
    for _ in range(300):
        token = "".join(rng.choice(list(letters + "01!.@"), int(rng.integers(1, 7))))
        found = []
        for path in product(*toxicity.lattice(token)):
            word = "".join(x for x, _ in path)
            marked = f"^^{word}$"
            p = sum(cost for _, cost in path) + sum(tri.get(marked[i : i + 3], -9.0) for i in range(len(word) + 1))
            found.append((p, word))
        best = max(p for p, _ in found)
        got = toxicity.decode(token, tri)
        assert abs(max(p for p, w in found if w == got) - best) < 1e-9, (token, got)


def test_words_score_like_a_plain_scan(spark):
    rng = np.random.default_rng(14)
    weights = {"moron": 3.0, "^idi": 2.0, "own$": 1.5, "clo": 1.3, "^the$": 1.2}
    scorer = toxicity.Scorer(toxicity.Model(weights, {}, 1.0, 0.0))
    for _ in range(50):
        text = " ".join(rng.choice("the then idiot moron clown clock brown stone moronic".split(), 12))
        each = {w: max((x for p, x in weights.items() if p in f"^{w}$"), default=0.0) for w in set(text.split())}
        assert scorer.raw(text) == sum(sorted(each.values(), reverse=True)[: toxicity.TOP])


def test_toxicity_with_few_rows_of_a_class(spark):
    rows = [(i, "a plain text of river and stone") for i in range(40)] + [(50, "moron clown idiot")]
    docs, marks = frame(spark, rows), frame(spark, [(i, int(i == 50)) for i, _ in rows], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs, marks, F.lit(True)).count() == 41  # one row of a class: partitions without any
    assert toxicity.toxicity(docs, marks.where("toxic = 0"), F.lit(True)).where("score <> 0").count() == 0
    empty = toxicity._counts(iter([]))
    assert {b.num_rows for b in empty} == {0}


def test_toxicity_learns_and_finds_disguises(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, random_text(rng, 40) + (" moron idiot clown" if bad else " ")))
        labels.append((i, int(bad)))
    rows += [(900, "the m0r0n and i d i o t of c.l.o.w.n"), (901, None), (902, ""), (903, "river stone " * 20_000), (0, rows[0][1]), (None, "moron idiot clown")]
    docs = frame(spark, rows).withColumns({"score": F.lit("c"), "piece": F.lit(0)})
    marks = frame(spark, [*labels, (5, None), (None, 1), (0, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks, F.col("doc_id") % 2 == 0).collect()}
    assert all((out[i] >= 0.7) == (i % 3 == 0) for i in range(1, 300, 2))
    assert out[900] >= 0.7 and out[901] == out[902] < 0.5 and out[903] < 0.5 and out[None] >= 0.7
    assert toxicity.toxicity(docs, marks.limit(0), F.lit(True)).where("score <> 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), marks, F.lit(True)).count() == 0


def test_toxicity_of_long_words_and_runs():
    tri = {m[i : i + 3]: -1.0 for w in "moron idiot clown stone".split() for m in (f"^^{w}$",) for i in range(len(m) - 2)}
    scorer = toxicity.Scorer(toxicity.Model({"moron": 4.0, "idiot": 3.0, "clown": 2.0}, tri, 1.0, 0.0))
    assert scorer.raw("stone" * 30 + "moron" + "stone" * 30) == 4  # one word of letters
    assert scorer.raw("st0ne," * 60 + "m0r0n") == 4  # a long token
    assert scorer.raw("x" * 41 + "m" + "ooo" + "r" * 3 + "o" * 3 + "n") == 4  # a long run with repetitions
    assert all(scorer.raw("stone" * k + "x" * pad + "m0r0n" + "stone" * k) == 4 for k in (4, 9) for pad in range(6))
    assert all(scorer.raw(".".join("stone" * 5 + "x" * pad + "moron" + "stone" * 5)) == 4 for pad in range(8))
    assert all(scorer.raw(" ".join("stone" * 5 + "x" * pad + "moron" + "stone" * 5)) == 4 for pad in range(8))
    assert scorer.raw(" ".join(("stone" * 4).join(["moron", "idiot", "clown"]))) == 9  # a passage has several words
    for long in ("1l" * 100_000, "a." * 100_000, "a" * 200_000 + "1", "0123456789" * 20_000, "a_" * 100_000 + "zz", "a b " * 50_000):
        assert scorer.raw(long) == 0
    docs = [pa.RecordBatch.from_pydict({"toxic": [0], "text": ["a " + "b" * 70 + "tail"]})]
    found = [b for b in toxicity._counts(iter(docs))]
    assert {b.schema for b in found} == {found[0].schema} and any("tail$" in b.column(1).to_pylist() for b in found)


# near duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints_are_spark_xxhash64_too(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("limits", [(256, 32_768), (1, 8)])
def test_simhash_like_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    base = [random_text(rng, 150) for _ in range(8)]
    docs = [(i, base[i % 8] + " " + " ".join(rng.choice(VOCAB, i % 5))) for i in range(80)] + [(200, None), (201, ""), (202, " \t"), (199, "one two"), (5, base[0]), (None, base[1]), (None, "lonely null words here now")]
    rows = frame(spark, docs).withColumns({"fp": F.lit("c"), "mask": F.lit(1), "component_id": F.lit(1)})
    out = simhash_groups(rows, crowd=limits[0], limit=limits[1]).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    assert [fingerprint(t) for _, t in docs] == fps
    want = sorted((d or -1, f, c or -1) for (d, _), f, c in zip(docs, fps, brute_components(fps, [d for d, _ in docs]), strict=True))
    assert sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in out) == want
    assert simhash_groups(rows.limit(0)).count() == 0


def test_masks_bring_near_pairs_together():
    rng = np.random.default_rng(6)
    for n in (10, 10**6, 10**8, 10**10):
        masks = _masks(n, 4, 256)
        for _ in range(200):
            a = int(rng.integers(0, 2**63))
            b = a
            for k in rng.choice(64, 4, replace=False):
                b ^= 1 << int(k)
            assert any(a & m == b & m for m in masks)
            m = next(m for m in masks if a & m == b & m)
            assert any(a & x == b & x for x in _refined(m, 4))


def test_near_pairs_and_forest():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, 300)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    bucket = np.sort(rng.integers(0, 3, 300))
    got = {(int(a), int(b)) for x, y in near_pairs(fps, bucket, 4) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for j in range(300) for i in range(j) if bucket[i] == bucket[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 4}
    chain = [(np.array([i]), np.array([i + 1])) for i in range(98, -1, -1)]
    assert (forest(101, iter(chain)) == [*[0] * 100, 100]).all()


# quality


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_like_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [random_text(rng, int(n), " ") for n in rng.integers(1, 200, 40)] + [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a", "x\nx\n \nx y", "#$ % <é> 日本\n" * 60, "same words again " * 4000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s"), (None, "q", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"words": F.lit("c"), "n_words": F.lit(1), "kept": F.lit(1)})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(docs).collect())
    assert got == sorted((d if d is not None else -1, *brute_counts(t)) for d, t, *_ in rows)
    for r in quality(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality(docs.limit(0)).count() == 0


def test_small_groups_take_wider_thresholds(spark):
    rng = np.random.default_rng(10)
    vocab = ["w%d" % i for i in range(500)]
    text = lambda sign: " ".join(w + sign for w in rng.choice(vocab, 80))
    rows = [(i, text(""), "en", "plain") for i in range(40)] + [(900, text("###"), "en", "tiny"), (901, text(""), "en", "tiny"), (902, text("###"), None, None), (903, text(""), "xx", None)]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[900] and kept[901] and not kept[902] and kept[903] and all(kept[i] for i in range(40))


def test_quality_of_texts_beyond_the_packed_places(spark, monkeypatch):
    """With room for 16 places, longer texts have their windows compared without the shortcut."""
    rng = np.random.default_rng(21)
    docs = frame(spark, [(i, random_text(rng, int(n)), "en", "s") for i, n in enumerate(rng.integers(0, 60, 40))], "doc_id bigint, text string, lang string, source string")
    want = sorted(map(tuple, quality(docs).collect()))
    monkeypatch.setattr("graphloom.llm.quality._BITS", 4)
    assert sorted(map(tuple, quality(docs).collect())) == want


def test_fingerprints_of_very_long_texts():
    rng = np.random.default_rng(22)
    for n in (65_539, 65_540, 140_000):
        text = " ".join(map(str, rng.integers(0, 500, n)))
        w = text.split()
        ones = np.zeros(64, dtype=np.int64)
        for i in range(n - 3):
            h = xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42)
            ones += np.unpackbits(np.array([h], dtype="<u8").view(np.uint8), bitorder="little")
        assert fingerprint(text) == sum(1 << b for b in range(64) if 2 * ones[b] > n - 3)


def test_quality_thresholds_follow_the_group(spark):
    rng = np.random.default_rng(9)
    vocab = ["w%d" % i for i in range(500)]
    text = lambda sign: " ".join(w + sign for w in rng.choice(vocab, 80))
    rows = [(i, text(""), "en", "plain") for i in range(40)] + [(100 + i, text("#"), "en", "signs") for i in range(40)] + [(900, text("###"), "en", "plain")]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(40)) and not kept[900]


def test_digests_of_empty_lists(spark):
    assert spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256).alias("x")).first().x == hashlib.sha256(b"").hexdigest()
