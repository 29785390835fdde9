"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import html
import os
import re
import time
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import llm.jaccard_join as jaccard_join
import llm.permutation_index as permutation_index
import llm.substring_dedup as substring_dedup
import llm.words as words
from llm.block_naming import drop_duplicates, exact_duplicates
from llm.common import among, connected_components, marked_places, small_batches
from llm.html_text import extract, main_text
from llm.jaccard_join import keep_first, near_duplicates, parity, shared_needed
from llm.language import identify, predict, train
from llm.license_scan import TEMPLATES, scan
from llm.mixing import budgets, mix, mixed_documents
from llm.packing import Tokens, first_fit_decreasing, pack
from llm.permutation_index import nearest
from llm.queries import QUERIES, RULES, SQL, WEIGHTS, source_levels
from llm.substring_dedup import remove_repeats, repeated_windows
from llm.url_filter import filter_urls, page_links
from llm.words import split_words
from nearkin import session
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, row string, budget int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(vocabulary, 300))
    passage = " ".join(rng.choice(vocabulary, 60))
    found = [None, "", "  \n ", "one", "One\ttwo", "one two", "a a a a a a", "É é Ünï x", "!!! ###", base, base, base.replace(" ", "\n"), base.upper()]
    for i in range(40):
        words = base.split()
        for at in rng.integers(0, 300, i // 4):
            words[at] = f"new{at}"
        found.append(" ".join(words))
    for i in range(20):
        found.append(" ".join(rng.choice(vocabulary, int(rng.integers(3, 90)))) + " " + passage)
    found += ["x y z " * 60, "x y z " * 60 + "q", " ".join(rng.choice(vocabulary, 9000)), "all rights reserved. ALL RIGHTS, reserved cc by-nc",
              "This work is licensed under the GNU General Public License, version 3.", "licensed under the nice apache license version 2 0"]
    found += [" ".join(f"s{i}" for i in range(n)) for n in (8, 9, 10, 11, 12, 19, 20, 21)] + [" ".join(f"s{i}" for i in range(1, 13))]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [f"src{i % 4}", None][i % 7 == 0], None, "c", "r", 1) for i, t in enumerate(texts())]
    rows += [rows[9], (None, "one two", "en", "src1", 3, "c", "r", 1)]  # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_equal_the_pattern():
    found = split_words(pa.array(texts() + ["\x1cq\x85z v\x0bw"]), lower=True)
    raw = found.data.tobytes()
    for t, text in enumerate(texts() + ["\x1cq\x85z v\x0bw"]):
        own = range(found.first[t], found.first[t + 1])
        assert [raw[found.start[i] : found.end[i]].decode() for i in own] == WORD.findall(lower(text))


def brute_components(rows, n, percent):
    sets = []
    for text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 60)])
def test_near_duplicates(docs, n, percent):
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    sets, label = brute_components([r[1] for r in rows], n, percent)
    got = Counter(map(tuple, near_duplicates(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == Counter((r[0], len(s), rows[c][0]) for r, s, c in zip(rows, sets, label))
    kept = Counter(r[0] for r in keep_first(docs, n, percent).collect())
    assert kept == Counter(r[0] for r, c in zip(rows, label) if rows[c][0] == r[0])


@pytest.mark.parametrize("n, percent", [(5, 80), (3, 90)])
def test_near_duplicates_of_one_template(spark, n, percent):
    """Copies of one text at distances around the limit, between which leaders decide, and long sets that share a passage."""
    draw = np.random.default_rng(n)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for length in (200, 700, 2000):
        template = list(draw.choice(words, length))
        for i in range(40):
            changed = list(template)
            for at in draw.choice(length, int(length * draw.choice([0.002, 0.005, 0.01, 0.02, 0.03, 0.05])), replace=False):
                changed[at] = f"x{draw.integers(10**9)}"
            rows.append(" ".join(changed[: length - int(draw.integers(0, 1 + length // 20))]))
        rows += [" ".join([*template[: length // 3], *draw.choice(words, length // 2)]) for _ in range(5)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    sets, label = brute_components(rows, n, percent)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, n, percent).collect()}
    assert [got[i] for i in range(len(rows))] == label and 10 < len(set(label)) < len(rows)


def test_hot_groups_can_be_split(docs):
    """Joins with what was gathered for a group read written tables on both sides; Spark splits a hot partition only of such a join."""
    small = docs.where(F.length("text") < 3000)
    for frame in (exact_duplicates(small), near_duplicates(small), keep_first(small)):
        plan = frame._jdf.queryExecution().optimizedPlan()
        assert "Aggregate" not in re.findall(r"^[ :+-]*(\w+)", plan.toString(), re.M)


def test_lists_keep_only_sets_of_sizes_that_can_link(spark):
    """A list entry goes if no other set of its list is near enough in size, and a set that shares too few lists."""
    rows = [(k, s, n) for k in (1, 2) for s, n in ((10, 100), (11, 120), (12, 105))] + [(3, 10, 100), (3, 13, 104), (4, 12, 105), (1, 10, 100)]
    posted = spark.createDataFrame(rows, "key long, set long, size int")
    got = {tuple(r) for r in jaccard_join._compatible(posted, 90).select("key", "set", "size", "lists").collect()}
    assert got == {(k, s, n, 2) for k in (1, 2) for s, n in ((10, 100), (12, 105))}


def test_posted_entries_and_outdated_lists_leave_the_disk(docs, monkeypatch):
    """Of the tables of list entries only the lists and those of the last round are still there at the end."""
    written, cut = [], jaccard_join.cut_lineage

    def noted(frame):
        table = cut(frame)
        written.append((set(frame.columns), session._WRITTEN.paths[-1]))
        return table

    monkeypatch.setattr(jaccard_join, "cut_lineage", noted)
    jaccard_join.similar_sets(docs)[0].collect()
    entries = [os.path.exists(path) for columns, path in written if {"key", "set", "size"} <= columns and "from" not in columns]
    assert len(entries) >= 5 and sum(entries) == 2


def test_only_tables_that_the_result_reads_stay(spark):
    """Of all tables written on the way, sets of n-grams included, two are left: those that the result reads."""
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words[:70], f"x{i}"])) for i in range(4)] + [(9, " ".join(words[::-1]))]
    for operator, number in ((near_duplicates, 5), (keep_first, 2)):
        first = session.written_tables()
        result = operator(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sum(bool(p) and os.path.exists(p) for p in session._WRITTEN.paths[first:]) == 2
        assert result.count() == number


def test_rows_among_marked_places(spark):
    rows, wanted = spark.range(200_000).selectExpr("nullif(id, 7) as id"), spark.range(0, 200_000, 1000).selectExpr("nullif(id, 0) as id")
    marked = marked_places(wanted, "id")
    found, others = ({r.id for r in among(rows, marked, "id", how=how).collect()} for how in ("left_semi", "left_anti"))
    assert found >= {None, *range(1000, 200_000, 1000)} and len(found) < 300
    assert not found & others and len(found) + len(others) == 200_000


def test_keep_first_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = "{} more".format
    rows = [(1, a), (None, near(a)), (None, "a text of its own"), (None, b), (None, near(b)), (None, near(near(b))),
            (5, c), (5, "another text of five"), (4, near(c)), (6, d), (6, near(d)), (None, None), (None, "")]
    kept = Counter(map(tuple, keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    sure = [(1, a), (None, "a text of its own"), (5, "another text of five"), (4, near(c)), (None, None), (None, "")]
    assert all(kept.pop(r) == 1 for r in sure)
    assert sorted(kept.values()) == [1, 1] and len(kept.keys() & set(rows[3:6])) == len(kept.keys() & set(rows[9:11])) == 1


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=50, deadline=None)
def test_parity_never_exceeds_the_difference(a, b):
    x, y = (parity(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
    assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)
    assert shared_needed(9, 10, 90) == 9


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("size", [3, 4096])
def test_exact_duplicates(docs, size):
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    rows = small.select("doc_id", "text").collect()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    count = Counter(normal)
    first = {n: min((r[0] for r, m in zip(rows, normal) if m == n and r[0] is not None)) for n in normal}
    got = exact_duplicates(small, size).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (r[0], first[n], count[n], hashlib.sha256(n.encode()).hexdigest()) for r, n in zip(rows, normal)
    )
    assert Counter(r.keep_id for r in got if r.kept) == Counter(set(first.values()))
    kept = drop_duplicates(small, size)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("least_hot", [2000, 3])
def test_repeated_passages(docs, least_hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", least_hot)
    rows = docs.select("doc_id", "text").collect()
    words = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, remove_repeats(docs).drop("kept_text").collect())) == want


def test_windows_cost_the_same_at_any_length(monkeypatch):
    # A round of mixing for each word of a window was half of the work of counting.
    strings = {t.encode(): 1 + i % 2 for i, t in enumerate({" ".join(WORD.findall(t or "")) for t in texts()}) if t.count(" ") > 50}
    done, spread = [], words.mix
    for k in (5, 35):
        mixed = []
        monkeypatch.setattr(words, "mix", lambda x, mixed=mixed: mixed.append(len(x)) or spread(x))
        assert list(repeated_windows(strings, k))
        done.append(sum(mixed))
    assert done[1] <= done[0]


@pytest.mark.parametrize("piece", [1 << 18, 500])
@pytest.mark.parametrize("kinds", [1 << 63, 7])
def test_equal_windows_by_their_words(piece, kinds, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SMALL_PIECE", piece)
    grams = words.Words.grams
    monkeypatch.setattr(words.Words, "grams", lambda self, n: grams(self, n) % np.uint64(kinds))
    plain = [t for t in {" ".join(WORD.findall(t or "")) for t in texts()} if 50 < t.count(" ") < 1000]
    strings = {t.encode(): 1 + i % 2 for i, t in enumerate(plain[:12])}
    count = Counter()
    for string, times in strings.items():
        w = string.split()
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] += times
    got = {s: mask.tolist() for s, mask in repeated_windows(strings, 35)}
    want = {s: [count[tuple(w[i : i + 35])] > 1 for i in range(len(w) - 34)] for s, w in ((s, s.split()) for s in strings)}
    assert got == {s: mask for s, mask in want.items() if any(mask)}


def test_packing(docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = pack(docs, TOKENIZER, group=16).toPandas()
    ids = [[*tokenizer.encode(r[0] or "", add_special_tokens=False).ids, 1] for r in docs.select("text").collect()]
    assert Counter(got.groupby("row").doc_tokens.first()) == Counter(map(len, ids))
    whole = Counter((zlib.crc32(np.array(i[a : a + 2048], "<u4").tobytes()), a) for i in ids for a in range(0, len(i), 2048))
    assert Counter(zip(got.ids_crc32, got.start)) == whole
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 2048


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=50, deadline=None)
def test_first_fit_decreasing(lengths):
    free: list[int] = []
    want = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        place = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if place == len(free):
            free.append(50)
        free[place] -= lengths[i]
        want[i] = place
    assert [s for s, _ in first_fit_decreasing(lengths, 50)] == want


def test_tokens_word_by_word():
    tokenizer, own = Tokenizer.from_file(TOKENIZER), Tokens(TOKENIZER)
    for text in ["It's THE end., don't %%% a<|endoftext|>B", "İİ Ünï—. x y\x1cz", "é. 12.5 a...b ###", "<|ENDOFTEXT|>."] + texts()[1:]:
        ids, cuts = own.ids(pa.array(["q", text, None, "q"])[1:])
        assert ids[cuts[0] : cuts[1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert cuts[1] == cuts[2] and len(cuts) == 4 and len(ids) == cuts[3]


def test_mixing(docs):
    got = mix(docs, source_levels(), WEIGHTS, percent=150).toPandas()
    total = sum(len(WORD.findall(r[0] or "")) for r in docs.select("text").collect())
    assert got.take_tokens.sum() == total * 150 // 100
    assert (got.take_tokens <= got.n_tokens).all() and got.epoch.max() <= 4
    mixed = mixed_documents(docs, source_levels(), WEIGHTS, percent=150)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r[0])) for r in mixed.select("text").collect()) == total * 150 // 100


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [(i, "t " * n, lang, source) for i, (n, lang, source) in enumerate([(10, "a", "p"), (100, "a", "q"), (100, "b", "r")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    got = mix(frame, levels, {}, budget=100, epochs=1).groupBy("origin").agg(F.sum("take_tokens")).collect()
    assert dict(map(tuple, got)) == {"p": 10, "q": 40, "r": 50}
    got = mix(frame, levels, {("b",): 0}, budget=1000, epochs=2).groupBy("origin").agg(F.sum("take_tokens")).collect()
    assert dict(map(tuple, got)) == {"p": 20, "q": 200}


def test_mixed_documents_keep_different_texts_apart(spark):
    rows = [(None, f"t{i} of five words here", "en", "src1") for i in range(8)]
    rows += [(3, "one two", "en", "src2"), (3, "two three", "en", "src2"), (3, "two three", "en", "src2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    got = mixed_documents(frame, levels, {}, budget=2 * 46, epochs=2)
    assert Counter(map(tuple, got.collect())) == Counter(rows * 2)


def brute_shares(nodes, budget):
    """``nodes``: name -> (weight, capacity); shares by filling up, in whole numbers of any size."""
    share, left = {}, min(budget, sum(c for w, c in nodes.values() if w))
    open_ = {n for n, (w, _) in nodes.items() if w}
    while full := {n for n in open_ if nodes[n][1] * sum(nodes[m][0] for m in open_) <= nodes[n][0] * left}:
        share |= {n: nodes[n][1] for n in full}
        left -= sum(nodes[n][1] for n in full)
        open_ -= full
    total = sum(nodes[n][0] for n in open_)
    share |= {n: nodes[n][0] * left // total for n in open_}
    odd = left - sum(share[n] for n in open_)
    return share | {n: share[n] + 1 for n in sorted(open_)[:odd]}


@pytest.mark.parametrize("most", [10**7, 10**8, 10**9, 10**10])
def test_mixing_budgets_of_large_leaves(spark, most):
    draw = np.random.default_rng(most)
    tokens = {(d, s): int(most * draw.random() ** 4) + 1 for d in "abc" for s in "pqrstu"}
    weights = {("a",): 5, ("b",): 3, ("c",): 2, ("a", "p"): 9, ("a", "q"): 2, ("b", "r"): 7, ("c", "u"): 3}
    capacity = {leaf: 4 * n for leaf, n in tokens.items()}
    leaves = spark.createDataFrame([(*leaf, n) for leaf, n in tokens.items()], "domain string, origin string, tokens long")
    for percent in (30, 100, 300):
        budget = sum(tokens.values()) * percent // 100
        domains = {d: (weights[d,], sum(c for leaf, c in capacity.items() if leaf[0] == d)) for d in "abc"}
        want = {
            (d, s): n for d, own in brute_shares(domains, budget).items()
            for s, n in brute_shares({s: (weights.get((d, s), 1), capacity[d, s]) for s in "pqrstu"}, own).items()
        }
        got = {(r.domain, r.origin): r.budget for r in budgets(leaves, ["domain", "origin"], weights, budget, 4).collect()}
        assert got == want and all(got[leaf] <= capacity[leaf] for leaf in got) and sum(got.values()) == budget


def test_license_scan(spark, docs):
    cases = [(1, "all rights reserved. ALL RIGHTS, reserved cc by-nc"), (2, None), (3, "Licensed under the nice Apache License, Version 2.0"),
             (4, "rights reserved all"), (5, "the general public license")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "cc-by,reserved")
    assert (got[2].n_words, got[2].n_base, got[2].labels, got[2].score) == (0, 0, "", 0.0)
    assert got[3].n_base == 0 and got[4].labels == "" and got[5].base_labels == "gpl" and got[5].first_word == 1
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        w, at = split.findall(lower(r[1])), []
        for phrase in (["cc", "by"], ["general", "public", "license"], ["all", "rights", "reserved"]):
            at += [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
        want[r[0], len(w), len(at), min(at, default=None), max(at, default=None)] += 1
    assert Counter(map(tuple, scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word").collect())) == want


def test_license_scan_of_changed_words(spark):
    cases, want = [], []
    for t in TEMPLATES:
        w = t.words
        changed = [w] + [w[:i] + ["x"] + w[i:] for i in range(1, len(w))]
        for i in range(len(w)):
            if w[i] not in t.names:
                changed += [w[:i] + w[i + 1 :], w[:i] + ["x"] + w[i + 1 :]]
        cases += [("q r s " + " ".join(c) + " y z") for c in changed]
        want += [t.label] * len(changed)
    cases += ["Licensed under the nice Apache License, Version 2.0", "released under the bsd license", "license mit the under released", "licensed under the x license version 2 0"]
    want += ["apache", None, None, None]
    got = scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(4)).select("doc_id", "labels", "score").collect()
    found = {r.doc_id: {x for x in r.labels.split(",") if x in {t.label for t in TEMPLATES}} for r in got}
    assert [(c, found[i]) for i, c in enumerate(cases)] == [(c, {x} if x else set()) for c, x in zip(cases, want)]
    assert all(r.score <= 1 for r in got)


def test_url_filter(spark):
    canonical = '<LINK rel=canonical href="{}">'.format
    rows = [(1, "http://A.example.net/es/1#x", None), (2, "http://b.org/1", canonical("http://a.example.net/es/1")), (3, None, ""), (4, "no scheme", "x"),
            (5, "http://c.org/2?q", '<meta http-equiv="refresh" content="0; url=/3">'), (6, "https://c.org/3", canonical("//www.ok.com/en/1")),
            (7, "http://d.example.com/en/", None), (8, "http://www.example.com/en/x", None), (9, "http://x.com", None), (1, "http://A.example.net/es/1#x", None)]
    got = sorted(filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect())
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in got] == [
        (1, "a.example.net", "net/es/", "block"), (1, "a.example.net", "net/es/", "block"), (2, "b.org", None, "block"), (3, "", None, "allow"),
        (4, "", None, "allow"), (5, "c.org", None, "allow"), (6, "c.org", None, "allow"), (7, "d.example.com", "example.com/en/", "block"),
        (8, "www.example.com", "www.example.com/en/", "allow"), (9, "x.com", None, "allow"),
    ]


def test_html_text(spark):
    page = """<html><body><nav><a href=x>menu</a></nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p>one
      <b>two</b><br>three<p>Ab.<script>var x="</p>"</script><p>A longer paragraph, with a <a href=y>link</a>, that goes on and on.</p>
      <div class="comments"><p>first!</p></div><form><input value=">">send</form></article><aside>side</aside><footer>&copy; f"""
    assert main_text(page) == "T & t\none two three\nAb.\nA longer paragraph, with a link, that goes on and on."
    assert main_text(None) == main_text("") == main_text("<p></p>") == "" and main_text("a < b") == "a < b"
    assert main_text('<p title="x>y</p>' * 3) is not None
    got = extract(spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(main_text(page))), (2, 0)]


def test_html_text_around_icons_and_formulas():
    icon = '<svg class="i"/>'
    page = f"""<body><div>{icon}<a href=x>home</a></div><article><h1>{icon}Title</h1><p>Before {icon}after, and <math/>then
      <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>Last <svg><title/><style/><path d="M0"/><text>drawn</text></svg>words.</p></article>"""
    assert main_text(page) == "Title\nBefore after, and then x=2 holds.\nLast words."
    assert main_text("<p>one <svg><path>two</p><p>three") == "one\nthree"


def test_html_text_below_names_that_only_resemble():
    body = "<p>A paragraph of some length that says what the article is about, and more of it.</p>" * 3
    want = "\n".join(["A paragraph of some length that says what the article is about, and more of it."] * 3)
    for name in ("site has-sidebar", "content-sidebar-wrap", "no-sidebar", "post-content share-enabled", "sidebar", "widget"):
        assert main_text(f'<body><div class="{name}"><div class="menu">menu</div>{body}</div></body>') == want
    page = f"""<body><div class="overlay"><article><h2 id="related">Related</h2>{body}<section id="related-work"><h3 id="legal-history">Law</h3></section>
      <p id="notice">A notice.</p><div class="Share x">tweet</div><div id="comments">first!</div></article></div><div class="big">{"<p>other</p>" * 9}</div></body>"""
    assert main_text(page) == f"Related\n{want}\nLaw\nA notice."
    little = f'<body><div><div class="sidebar"><article><p>{body}</p></article></div><p>{"long " * 200}</p></div></body>'
    assert want in main_text(little)


def test_url_links(spark):
    base = "http://a.org/x/y.html?z=1"
    cases = {
        '<link rel="canonical" href="/go?u=http://bad.net/es/p">': "a.org/go?u=http://bad.net/es/p",
        '<!-- <link rel="canonical" href="http://bad.net/es/1"> -->': None,
        '<script>var x = \'<link rel="canonical" href="http://bad.net/es/2">\';</script>': None,
        '<link data-rel="canonical" rel="next" href="http://bad.net/es/3">': None,
        '<link rel="canonical" data-href="http://bad.net/es/4" href="http://c.org/4">': "c.org/4",
        '<link title=\'rel="canonical"\' href="http://bad.net/es/5">': None,
        '<link rel="canonical" href="?p=2">': "a.org/x/y.html?p=2",
        '<link rel="canonical" href="../q#top">': "a.org/q",
        '<link rel="canonical" href="./r/../s/.">': "a.org/x/s/",
        '<link rel="canonical" href="/../../t">': "a.org/t",
        '<link rel="canonical" href="http://c.org/?a=1&amp;b=2&#38;c=3&#x26;d=4&copy">': "c.org/?a=1&b=2&c=3&d=4&copy",
        '<link rel="shortlink CANONICAL" href=//C.org/9>': "c.org/9",
        '<link href="http://c.org/10" rel=canonical title="a > b">': "c.org/10",
        '<link rel=canonical href="mailto:x@y.z">': None,
        '<link rel=canonical href="#here">': None,
        '<meta http-equiv="Refresh" content="0; URL=\'http://c.org/12\'">': "c.org/12",
        '<meta name="refresh" content="0; url=http://bad.net/es/13">': None,
        '<meta http-equiv=refresh content=5>': None,
        "<link rel=canonical": None,
    }
    pages = spark.createDataFrame([(i, base.replace("y", f"y{i}"), h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r.a: r.b for r in page_links(pages).collect()}
    want = {f"a.org/x/y{i}.html?z=1": b and b.replace("y.html", f"y{i}.html") for i, b in enumerate(cases.values())}
    assert got == {a: b for a, b in want.items() if b}
    assert all(r.verdict == "allow" for r in filter_urls(pages, RULES).collect())


def article_of(page):
    """The blocks of a given page's article element, read with patterns."""
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)[1]
    blocks = re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", inner)
    lines = [" ".join(html.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(line for line in lines if line)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_html_text_of_all_given_pages_is_their_article(spark, sf):
    pages = spark.read.parquet(f"{DATA}/{sf}/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_html_text_without_an_article_element():
    body = "<p>A paragraph of some length that says what the article is about, and more of it.</p>" * 3
    text = "\n".join(["A paragraph of some length that says what the article is about, and more of it."] * 3)
    assert main_text(f"<article><h1>T</h1><p><b>{text[:79]}</b><br></article>") == f"T\n{text[:79]}"
    menu = "<ul><li><a href=1>Home</a><li><a href=2>About us</a><li><a href=3>Contact</a></ul>"
    assert main_text(f"<body>{menu}<h1>Title</h1>{body}<p>End.") == f"Title\n{text}\nEnd."
    assert main_text(f"<body><div>{menu}</div><div><h2>T</h2>{body}<p>End.</p><ul><li>one</li><li>two</li></ul></div></body>") == f"T\n{text}\nEnd.\none\ntwo"
    talk = "<div><p>Great post, thanks a lot for it, really, I learned so much!</p></div>"
    assert main_text(f"<body><article><h1>T</h1>{body}</article>{talk * 9}</body>") == f"T\n{text}"
    assert main_text(f"<body><main><div><h1>T</h1></div><div>{body}</div></main>{talk}</body>") == f"T\n{text}"


def test_html_text_takes_time_in_proportion():
    for part in ("<font><h2>x</h2>", "<b><div><font></b>", "<li><font>", "<p><i>x", "<svg><g>", "</b></p></div>"):
        page = part * (1_000_000 // len(part))
        begin = time.process_time()
        main_text(page)
        assert time.process_time() - begin < 30


def test_nearest(spark):
    frame = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = frame.collect()
    bad = [(9001, [float("nan")] * 64), (9002, None), (9003, [0.0] * 64), (9004, [None] * 64), (None, rows[1][1]), (9005, rows[1][1])]
    frame = frame.select("vec_id", "embedding").unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = nearest(frame).toPandas()
    ids = np.array([r[0] for r in rows] + [9005])
    vectors = np.array([r[1] for r in rows] + [rows[1][1]], dtype=float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        other = np.flatnonzero(ids != ids[q])
        want = ids[other[np.lexsort((ids[other], -score[other]))[:20]]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert len(own) == 20 and (np.diff(own.score) <= 1e-12).all()
        hit, total = hit + len(set(want) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_nearest_of_mixed_widths(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=2).tolist()) for i in range(60)] + [(60, [1.0, 2.0, 3.0]), (61, [1.0, 0.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60} and [r.vec_id for r in got if r.query_id == 60] == [61]
    v = np.array([r[1] for r in rows[:60]])
    for q in (0, 20, 40):
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        score = v @ v[q]
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:20]
        assert len(set(want) & {i for _, i in own}) >= 18 and len(own) == 20


def test_language(spark):
    got = identify(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).where("held_out").select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and not any(r.rejected for r in got)


def slow_trigrams(text):
    """Trigram counts by place, letter by letter."""
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode())
    found = Counter()
    for i in range(len(raw) - 2):
        if raw[i : i + 3] != b"   ":
            found[int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32 >> 19] += 1
    return found


def test_language_against_brute_force(spark):
    """Document frequencies, weights and nearest centroids one by one; the same model for any partitioning."""
    frame = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("doc_id % 5 = 0 and length(text) < 4000")
    model, again = train(frame), train(frame.repartition(7))
    assert np.allclose(model.centroids, again.centroids, atol=1e-7) and np.array_equal(model.idf, again.idf)
    rows = frame.collect()
    counts = [slow_trigrams(r.text) for r in rows]
    learned = [c for c, r in zip(counts, rows) if r.text is not None and r.lang is not None]
    often = Counter(p for c in learned for p in c)
    idf = np.array([np.log((1 + len(learned)) / (1 + often[p])) + 1 for p in range(len(model.idf))])
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert np.allclose((model.centroids**2).sum(axis=0), 1, atol=1e-4) and model.languages == sorted({r.lang for r in rows if r.lang})
    got = {r.doc_id: r for r in predict(frame, model).collect()}
    for r, c in zip(rows, counts):
        vector = {p: np.log1p(n) * idf[p] for p, n in c.items()}
        length = np.sqrt(sum(v * v for v in vector.values())) or 1.0
        cosine = sum((model.centroids[p].astype(float) * v / length for p, v in vector.items()), np.zeros(model.centroids.shape[1]))
        best = cosine.argmax()
        own = got[r.doc_id]
        if re.search(r"[^\W\d_]", r.text or ""):
            assert abs(own.score - min(max(cosine[best], 0), 1)) < 1e-4
            near = {model.languages[k // model.clusters] for k in np.flatnonzero(cosine > cosine[best] - 1e-4)}
            assert own.lang_pred in near
            total = sum(c.values())
            assert own.rejected == (own.score < model.least[min(int(np.log2(1 + total)), len(model.least) - 1)])
        else:
            assert (own.lang_pred, own.score, own.rejected) == ("und", 0.0, True)


def test_language_learns_from_every_document(spark):
    """Words that one document of many has leave their mark on the centroids."""
    text = "concat('mnop qrst', CASE WHEN id % 500 = 0 THEN concat(' ', repeat(char(97 + CAST(id / 500 AS INT) % 12), 3)) ELSE '' END)"
    frame = spark.range(12_000).selectExpr("id AS doc_id", f"{text} AS text", "'xx' AS lang")
    model = train(frame)
    for i in range(12):
        places = list(slow_trigrams(chr(97 + i) * 3))
        assert len(places) == 1 and model.idf[places[0]] == np.float32(np.log(12_001 / 3) + 1)
    assert all((model.centroids[list(slow_trigrams(f"qrst {chr(97 + i) * 3}"))] > 0).any(axis=1).all() for i in range(12))


def test_language_of_odd_rows(docs):
    got = identify(docs).collect()
    assert all((r.lang_pred == "und" and r.rejected) == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, no_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [near_duplicates(no_docs), exact_duplicates(no_docs), remove_repeats(no_docs), pack(no_docs, TOKENIZER), scan(no_docs), identify(no_docs),
              mix(no_docs, source_levels(), WEIGHTS), mixed_documents(no_docs, source_levels(), WEIGHTS), filter_urls(pages, RULES), extract(pages), nearest(vectors)]
    assert all(f.count() == 0 for f in frames)


def test_pipeline_stages(spark, docs, tmp_path):
    frame = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.count()
        stage(spark, frame, "").write.parquet(str(tmp_path / str(n)))
        frame = spark.read.parquet(str(tmp_path / str(n)))
        if name in ("language_id", "exact_dedup", "jaccard_join"):
            assert 0 < frame.count() < before and frame.columns == docs.columns
    assert {"doc_id", "sequence_id", "offset"} <= set(frame.columns)


def test_stages_keep_columns_with_any_names(spark, docs):
    names = ["_id", "_sha", "_own", "_take", "score", "k", "row", "take", "tokens", "Rejected", "digest"]
    rows = [(i, t, ["en", "de"][i % 2], f"src{i % 4}", None, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts()) if len(t or "") < 3000]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, "")
        assert got.columns == frame.columns
        found = got.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    folder = f"{DATA}/sf0.001"
    got = QUERIES[name](spark, folder).toArrow()
    assert got.num_rows
    if name in SQL:
        duck = duckdb.connect()
        for table in ("documents", "pages"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = duck.sql(SQL[name]).to_arrow_table()
        names = sorted(got.column_names)
        assert names == sorted(want.column_names)
        as_rows = lambda t: sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names])))
        assert as_rows(got) == as_rows(want)


def test_footrule_gains_and_measured_rows():
    draw = np.random.default_rng(5)
    queries, rows = (np.argsort(draw.random((n, 32)), axis=1)[:, :12].astype(np.uint16) for n in (7, 40))
    gains = permutation_index.footrule_gains(queries, rows, 32)
    for q, r in product(range(7), range(40)):
        places = {p: j for j, p in enumerate(rows[r])}
        assert gains[q, r] == sum(12 - max(i, places[p]) for i, p in enumerate(queries[q]) if p in places)
    qv, rv = draw.integers(-2, 3, (7, 4)).astype(float), draw.integers(-2, 3, (40, 4)).astype(float)
    near = np.tile(np.arange(40), (7, 1))
    valid = draw.random((7, 40)) < 0.8
    q, r = permutation_index.measured_rows(qv, rv, near, valid, 5)
    for i in range(7):
        scores = np.where(valid[i], rv @ qv[i], -np.inf)
        assert set(r[q == i]) == {j for j in range(40) if valid[i, j] and scores[j] >= np.sort(scores)[-5]}


def test_rarity_counters_add_up():
    draw = np.random.default_rng(6)
    parts = [np.where(draw.random(1 << 16) < p, draw.integers(1, 9, 1 << 16), 0).astype(np.uint32) for p in (0.001, 0.6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([jaccard_join._sparse(p)], pa.binary())], ["counts"]) for p in parts]
    assert (jaccard_join._added(iter(batches)) == sum(parts)).all()
    often = jaccard_join.how_often(np.array([0.0, 1, 2, 3, 1000, 2.0**63]))
    assert often[0] == 0 and often[-1] == 255 and (np.diff(often.astype(int)) > 0).all()


def test_leaders_stop_where_they_contract_nothing(spark, monkeypatch):
    """Sets that share a passage and are not alike stay in one list; leaders are not tried round after round for a link each."""
    passage = [f"common{i}" for i in range(4)]
    rows = [(i, " ".join([*passage, *(f"w{i}_{j}" for j in range(8))])) for i in range(400)]
    chains = [(1000 + 100 * c + i, " ".join(f"c{c}_{j}" for j in range(6 * i, 6 * i + 80))) for c in range(3) for i in range(8)]
    docs = spark.createDataFrame(rows + chains, "doc_id long, text string")
    turns, pairs = [], jaccard_join._leader_pairs

    def noted(*args):
        turns.append(args[-1])
        return pairs(*args)

    monkeypatch.setattr(jaccard_join, "_leader_pairs", noted)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 80).collect()}
    assert turns == [0, 1]
    assert got == {i: i for i, _ in rows} | {i: i // 100 * 100 for i, _ in chains}


def test_long_texts_come_to_python_in_small_batches(spark):
    """What Python holds of a table of long texts at once is bounded by bytes, not by 10,000 rows."""

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], ["bytes", "rows"])

    small_batches(spark)
    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))
    seen = docs.mapInArrow(measure, "bytes long, rows long").agg(F.max("bytes").alias("most"), F.sum("rows").alias("rows")).first()
    assert seen["most"] < 6 << 20 and seen["rows"] == 4000
