"""Each operator against a brute-force version on given documents and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm import decontaminate, line_dedup, minhash, mixing, packing, quality_cnn, quality_rules, repeats, secret_scan, toxicity

SPACES = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PLAIN_WORDS = "some ordinary words that no benchmark item has ever used before in this or any other order"


#: Documents that hold benchmark items without an id and with an odd one.
PLANTED = [(901, f"x {PLAIN_WORDS} y"), (902, "a three word item")]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def given(spark, sample):
    return spark.read.parquet(f"{sample}/documents.parquet")


@pytest.fixture(params=["given", "odd"])
def docs(request, spark, sample, odd):
    return odd if request.param == "odd" else given(spark, sample)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(pair):
    return pair[0] is not None, pair[0] or 0


def test_secret_spans(docs):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    expected = []
    for i, t in texts(docs):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        expected.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = [tuple(r) for r in secret_scan.secret_report(docs).collect()]
    assert Counter(got) == Counter(expected)


def test_failing_match_hides_what_it_covers(spark):
    df = spark.createDataFrame([(1, "password: token: abcdef1234")], "doc_id int, text string")
    assert secret_scan.secret_report(df).first()["n_assign"] == 0


def test_spans_of_repeated_rows(spark):
    text = "0123456789 token: abcdef1234 and secret=zyxwvu9876 then AKIA" + "Z" * 20
    df = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text), (None, text), (None, text)], "doc_id long, text string")
    got = secret_scan.secret_report(df).collect()
    assert len(got) == 6 and {r["spans"] for r in got} == {"assign:11:28,assign:33:50,access:56:80"}


def test_ledger_scans_only_unseen(spark, odd, tmp_path):
    path = str(tmp_path / "ledger")
    first = sorted(map(str, secret_scan.secret_report(odd, path).collect()))
    ledger = secret_scan.Ledger(spark, path)
    n = ledger.scanned().count()
    more = odd.unionByName(odd.where("doc_id = 12").withColumn("doc_id", F.lit(99).cast("long")))
    again = secret_scan.secret_report(more, path).collect()
    assert secret_scan.Ledger(spark, path).scanned().count() == n and len(again) == len(first) + 1
    assert next(r for r in again if r["doc_id"] == 99)["n_assign"] == 1
    secret_scan.secret_report(spark.createDataFrame([(50, "new secret=abcdefgh")], "doc_id long, text string"), path)
    assert secret_scan.Ledger(spark, path).scanned().count() == n + 1


def test_repeats(docs):
    seen, expected = set(), {}
    rows = sorted({(i, t or "") for i, t in texts(docs)}, key=order)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        expected[i, len(b)] = (sum(gone), runs, hashlib.sha256(kept).hexdigest())
    if len({i for i, _ in rows}) < len(rows):
        rows = [r for r in rows if r[0] is not None]  # two texts under the null id are ordered by hash
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"], r["n_bytes"]], r["doc_id"]


def test_repeats_of_split_groups(docs, monkeypatch):
    whole = sorted(map(str, repeats.remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "GROUP", 2)
    monkeypatch.setattr(repeats, "SLAB", 5000)
    assert sorted(map(str, repeats.remove_repeats(docs).collect())) == whole


def test_repeat_groups_have_all_occurrences(spark):
    passage = "".join(chr(97 + x) for x in np.random.default_rng(2).integers(0, 20, 130))
    df = spark.createDataFrame([(i, f"{'xyz'[i] * 30}{passage}{'uvw'[i] * 30}") for i in range(3)], "doc_id int, text string")
    groups = defaultdict(set)
    for r in repeats.repeat_groups(df).collect():
        groups[r["group_id"]].add((r["doc_id"], r["first"]))
    assert {(0, 30), (1, 30), (2, 30)} in groups.values()


@pytest.mark.parametrize("group", [4000, 2])
def test_repeat_groups_are_all_maximal_repeats(spark, monkeypatch, group):
    """Nested repeats, repeats longer than the contexts, inside one text, at text ends and in split groups."""
    r = np.random.default_rng(8)
    some = lambda n: "".join(chr(97 + x) for x in r.integers(0, 20, n))
    base, short = some(420), some(130)
    rows = [(1, some(20) + base[:150] + some(15)), (2, some(9) + base[:150] + some(30)), (3, some(12) + base[:120] + some(10)), (4, base), (5, some(7) + base),
            (6, base[40:] + some(3)), (7, short + some(5) + short), (8, some(4) + short), (8, some(4) + short), (None, short), (9, "ab" * 80)]
    monkeypatch.setattr(repeats, "GROUP", group)
    places = defaultdict(set)
    for i, t in set(rows):
        for a in range(len(t)):
            for b in range(a + 100, len(t) + 1):
                places[t[a:b]].add((i, a, t[a - 1] if a else (i, a), t[b] if b < len(t) else (i, b)))
    expected = Counter((i, a, len(x)) for x, own in places.items() if len(own) > 1 and len({p[2] for p in own}) > 1 and len({p[3] for p in own}) > 1 for i, a, _, _ in own)
    got = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x["doc_id"], x["first"], x["length"]) for x in got) == expected
    assert {120, 150, 420} <= {x["length"] for x in got}


def test_prefix_intervals():
    first, last, depth, around = repeats.prefix_intervals(np.array([3, 5, 5, 2, 0, 4]), 1)
    assert sorted(zip(first.tolist(), last.tolist(), depth.tolist(), around.tolist())) == [(0, 3, 3, 2), (0, 4, 2, 0), (1, 3, 5, 3), (5, 6, 4, -1)]


def test_rule_counts_and_base(docs):
    expected = []
    for i, t in texts(docs):
        t = t or ""
        w = re.findall(SPACES, t)
        lines = [x for x in t.split("\n") if re.search(SPACES, x)]
        runs = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if runs[tuple(w[k:k + 8])] > 1 for j in range(8)}
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality_rules.quality_verdicts(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter(expected)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_sketches_merge_to_the_sketch_of_all(spark, sample):
    counted = given(spark, sample).select("lang", "source", quality_rules.rule_counts(F.col("text")).alias("rule_counts"))
    by_parts = quality_rules.merged(quality_rules.sketches(counted, ["lang", "source"]), ["lang"])
    assert sorted(map(str, by_parts.collect())) == sorted(map(str, quality_rules.sketches(counted, ["lang"]).collect()))


def test_rules_keep_good_and_reject_junk(spark):
    folder = "/root/testdata/sf0.01"
    got = quality_rules.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1


def test_sketches_set_the_limits(spark):
    """The same share of capitals, symbols or long words passes in a source where it is usual and fails where it is not."""
    r = np.random.default_rng(4)

    def text(capitals, letters, symbols=0):
        own = ["".join(chr(97 + c) for c in r.integers(0, 26, letters + int(r.integers(0, 2)))) for _ in range(100)]
        own = [w.capitalize() if k < capitals + int(r.integers(0, 4)) else w for k, w in enumerate(own)]
        return " ".join(own) + " " + "#" * symbols

    rows = [(i, text(*((4, 4), (60, 9))[i % 2]), "en", ("plain", "loud")[i % 2]) for i in range(600)]
    odd_ones = [(60, 4), (4, 9), (4, 4, 16)]
    rows += [(1000 + 10 * k + s, text(*x), "en", ("plain", "loud")[s]) for k, x in enumerate(odd_ones) for s in (0, 1)]
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert np.mean([kept[i] for i in range(600)]) > 0.97
    assert [kept[1000 + 10 * k] for k in range(3)] == [False] * 3
    assert kept[1011] and not kept[1021]


def test_line_dedup(docs):
    rows = sorted({(i, t or "") for i, t in texts(docs)}, key=order)
    equal, full, sub, less, expected = set(), set(), set(), set(), {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = tuple(re.findall(r"[^ \t\n\r\x0b\x0c]+", line))
            if w in equal:
                continue
            u, least = (w, 8) if len(w) >= 8 else (" ".join(w), 16)  # words, else characters
            cuts = [u[:k] + u[k + 1:] for k in range(len(u))] if least <= len(u) < 3000 else []
            longer = cuts if len(u) > least else []
            near = any((c, k) in sub for k, c in enumerate(cuts)) or (len(u) >= least and u in less) or any(c in full for c in longer)
            if w:
                equal.add(w)
                full.add(u)
                sub.update((c, k) for k, c in enumerate(cuts))
                less.update(longer)
            if not near:
                kept.append(line)
        expected[i, len(t)] = "\n".join(kept)
    by_id = Counter(i for i, _ in rows)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == docs.count()
    sizes = dict(rows)
    for r in got:
        if by_id[r["doc_id"]] == 1:
            assert r["kept"] == expected[r["doc_id"], len(sizes[r["doc_id"]])], r["doc_id"]


def test_short_lines(spark):
    """Lines of few words by one character: substituted, deleted, added, without spaces, and what must stay."""
    lines = {
        1: "Copyright 2019 by Example Co\nall rights reserved\n1.\nfile a", 2: "Copyright 2018 by Example Co\nall rights reservd\n2.\nfile b",
        3: "all rights reserved.\n\nCopyright 2031 by Example Co", 4: "\u98df" * 20 + "\u54c1", 5: "\u98df" * 19 + "\u54c1\u54c1", 6: "\u98df" * 22 + "\u54c1",
        7: "a b c d e f g hh", 8: "abcdefghijklmnop", 9: "a b c d e f ghh",
    }
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(lines.items()), "doc_id long, text string")).collect()}
    assert got == lines | {2: "2.\nfile b", 3: "\nCopyright 2031 by Example Co", 5: ""}


def test_many_lines_in_one_document(spark):
    rows = spark.sql("select 1L doc_id, array_join(transform(sequence(1, 200000), i -> concat('entry ', i % 150000, if(i % 7 = 0, '\\n', ''))), '\\n') text")
    r = line_dedup.dedup_lines(rows).first()
    assert r["n_lines"] == 200000 + 200000 // 7 and r["n_near"] == 0 and r["n_equal"] == 50000


def near_labels(rows):
    """Class number of each (id, text) by comparing all pairs, and the least id of each class."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            shared = sum((x & y).values())
            if (rows[a][1] or "") == (rows[b][1] or "") or shared and shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                old, new = label[a], label[b]
                label = [new if z == old else z for z in label]
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c), key=lambda i: (i is not None, i or 0)) for c in set(label)}
    return label, least


def test_near_duplicates(docs):
    rows = texts(docs)
    label, least = near_labels(rows)
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((rows[k][0], least[label[k]]) for k in range(len(rows)))
    assert minhash.keep_first(docs).count() == len(set(label))


def test_near_links_that_no_leader_shows(spark):
    """Variants of one text near the similarity on both sides: members of a band that are unlike its leaders."""
    r = np.random.default_rng(11)
    rows = []
    for family in range(6):
        words_of_base = [f"w{family}x{k}" for k in range(160)]
        for branch in range(25):
            mine = list(words_of_base)
            for k in r.choice(160, 4, replace=False):
                mine[k] = f"b{family}x{branch}x{k}"
            for leaf in range(2):
                own = list(mine)
                own[int(r.integers(160))] = f"l{leaf}x{branch}"
                rows.append((len(rows), " ".join(own)))
    label, least = near_labels(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(df).collect()}
    assert got == {rows[k][0]: least[label[k]] for k in range(len(rows))}
    assert 20 < len(set(label)) < 300


def test_prefix_join_finds_all_links_between_classes(spark):
    """Every text as its own class: the join alone must give all pairs of at least the similarity."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**31, 120).astype(np.uint32)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[r.choice(120, int(r.integers(2, 20)), replace=False)] = r.integers(0, 2**31, 1)[0]
        sets.append(np.unique(own))
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, units binary")
    members = df.selectExpr("node", "node as label")
    got = {(x["a"], x["b"]) for x in minhash.crossing_pairs(minhash.prefixes(df, members, 0.8), 0.8).collect()}
    near = {(a, b) for b in range(60) for a in range(b) if np.intersect1d(sets[a], sets[b]).size >= 0.8 * np.union1d(sets[a], sets[b]).size}
    assert near and near <= got


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    a, b = minhash.units(np.concatenate([base[:300], base[:100]])), minhash.units(np.concatenate([base[60:], base[60:100]]))
    both = np.intersect1d(a, b).size / np.union1d(a, b).size
    s = minhash.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - both) < 0.12


def test_mixture_meets_entropy_and_budget(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 10 < 7 else f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = mixing.token_counts(df)
    plan = {r["source"]: r for r in mixing.source_plan(counts).collect()}
    weights = np.array([p["weight"] for p in plan.values()])
    assert abs(weights.sum() - 1) < 1e-9 and -(weights * np.log(weights)).sum() >= 0.97 * np.log(len(plan)) - 1e-4
    shown = mixing.mixed(df).collect()
    tokens = Counter()
    for r in shown:
        tokens[r["source"]] += r["tokens"]
    for source, p in plan.items():
        assert p["budget"] - 7 <= tokens[source] <= p["budget"]
    assert max(p["budget"] / p["total"] for p in plan.values()) <= mixing.MAX_REPEATS + 0.01
    copies = Counter(r["doc_id"] for r in shown)
    assert mixing.take_mixture(df).count() == sum(copies.values())


def test_mixture_of_rows_with_one_id(spark):
    """A source above its weight whose rows share the null id, and one of equal rows, lose the part that does not fit and no more."""
    rows = [(None, f"w {i} w", "big") for i in range(2000)] + [(7, "same old words", "equal")] * 1000 + [(i, "w w w", f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["source"]: r for r in mixing.source_plan(mixing.token_counts(df)).collect()}
    assert plan["big"]["budget"] < plan["big"]["total"] and plan["equal"]["budget"] % plan["equal"]["total"]
    for shown in (mixing.mixed(df), mixing.take_mixture(df)):
        tokens = {r["source"]: 3 * r["count"] for r in shown.groupBy("source").count().collect()}
        for source in ("big", "equal"):
            assert plan[source]["budget"] - 9 <= tokens[source] <= plan[source]["budget"]
    counts = {(r["source"], r["block"]) for r in mixing.mixed(df).where("source = 'big'").collect()}
    assert len(counts) > 500


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    leak = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix"
    rows = [(None, leak), (None, PLAIN_WORDS), (None, None), (1, leak), (1, PLAIN_WORDS), (2, PLAIN_WORDS), (3, leak)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("fox", leak)], "item_id string, text string")
    got = Counter(tuple(r) for r in decontaminate.keep_clean(df, bench).collect())
    assert got == Counter([(None, PLAIN_WORDS), (None, None), (1, PLAIN_WORDS), (2, PLAIN_WORDS)])


def test_decontamination(spark, sample, docs):
    bench = spark.read.parquet(f"{sample}/benchmark.parquet").selectExpr("item_id", "text", "1 as node")
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()] + [("short", "one"), ("nil", None), ("", PLAIN_WORDS), ("nul\x00byte", "three word item"), ("fox", "the quick brown fox jumps over the lazy dog while seven wizards quietly mix")]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(i)
    expected = []
    for i, t in texts(docs) + PLANTED:
        w, cover, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if hit := windows.get(tuple(w[k:k + n])):
                    cover.update(range(k, k + n))
                    found |= hit
        expected.append((i, len(w), len(cover), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(cover) and 20 * len(cover) >= len(w)))
    frame = spark.createDataFrame([(i or None, t) for i, t in items], "item_id string, text string")
    docs = docs.unionByName(spark.createDataFrame(PLANTED, "doc_id long, text string"), True)
    for size in (decontaminate.BENCHMARK_BLOCK_BYTES, 2000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decontaminate, "BENCHMARK_BLOCK_BYTES", size)
            got = decontaminate.decontaminate(docs, frame).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == Counter(expected)


def test_proximity_matches(spark, sample, monkeypatch):
    """Every listed match and no other, against all windows at all places; a passage with three words changed and one put in is found."""
    fox = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent brews"
    changed = "well then quick brown cat jumps over the lazy dog while seven very wizards quietly stir potent brews"
    rows = [(1, fox), (2, changed), (None, changed), (3, fox[4:]), (4, " ".join(reversed(fox.split()))), (5, None), (6, ""), (7, "the fox " * 40 + fox), (8, "mix potent brews")]
    rows += [(100 + i, t) for i, t in enumerate(x["text"] for x in given(spark, sample).limit(20).collect())]
    items = [("fox", fox), (None, "short one"), ("nil", None)] + [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sample}/benchmark.parquet").limit(3).collect()]
    often = Counter(w for _, t in rows for w in words(t))
    expected = Counter()
    for name, t in items:
        w = words(t)
        size = min(13, len(w))
        need = -(-3 * size // 4)
        for s in range(len(w) - size + 1 if size else 0):
            window = w[s:s + size]
            rare = sorted(range(size), key=lambda k: (often[window[k]], k))[:size - need + 1]
            for doc, text in rows:
                d = words(text)
                for p in {q - k for k in rare for q, x in enumerate(d) if x == window[k]}:
                    n = sum(window[k] in d[max(0, p + k - 2):max(0, p + k + 3)] for k in range(size))
                    if n >= need:
                        expected[doc, name or "", s, p, n, p >= 0 and d[p:p + size] == window] += 1
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (decontaminate.BENCHMARK_BLOCK_BYTES, 200):
        monkeypatch.setattr(decontaminate, "BENCHMARK_BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "_CANDIDATES", size)
        got = decontaminate.matches(index, bench).collect()
        assert Counter((r["doc_id"], r["item_id"], r["window_start"], r["position"], r["n_terms"], r["exact"]) for r in got) == expected
    assert {(1, True), (2, False), (None, False)} <= {(r["doc_id"], r["exact"]) for r in got} and not any(r["doc_id"] == 4 for r in got)


def test_packed_rows_become_batches_as_they_are_needed():
    taken = []
    rows = ((b"i", [0, 1], b"p", [k], [0], 1) for k in range(600) if taken.append(k) is None)
    batches = packing._record_batches(rows)
    assert next(batches).num_rows == len(taken) == 256
    assert [b.num_rows for b in batches] == [256, 88]


def test_packing_round_trip(docs):
    tokenizer = packing.Tokenizer()
    pieces, rows = defaultdict(list), packing.pack_tokens(docs, seq_len=256).collect()
    for r in rows:
        ids, bounds, positions = np.frombuffer(r["ids"], "<u4"), r["cu_seqlens"], np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == 256 and bounds[0] == 0 and bounds[-1] == r["n_tokens"] <= 256
        for k, (doc, offset) in enumerate(zip(r["doc_ids"], r["offsets"])):
            assert positions[bounds[k]:bounds[k + 1]].tolist() == list(range(bounds[k + 1] - bounds[k]))
            pieces[doc].append((offset, ids[bounds[k]:bounds[k + 1]]))
    stream = defaultdict(Counter)
    for doc, t in texts(docs):
        if t:
            stream[doc][t] += 1
    assert set(stream) == set(pieces)
    for doc, own in stream.items():
        if sum(own.values()) == 1:
            ids = np.concatenate([x for _, x in sorted(pieces[doc], key=lambda p: p[0])])
            assert ids[-1] == packing.SEPARATOR and tokenizer.decode(ids[:-1]) == next(iter(own))
            assert ids[:-1].tolist() == tokenizer.coder.encode_ordinary(next(iter(own)))


def test_best_fit_decreasing():
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 101, 300)]
    rooms, expected = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            rooms[min(fits)[1]] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
    got = packing.best_fit(lengths, 100)
    assert sorted(i for row in got for i in row) == list(range(300)) and len(got) == len(rooms)
    assert all(sum(lengths[i] for i in row) <= 100 for row in got)


@pytest.mark.parametrize("score, label, held", [(toxicity.score_toxicity, "toxic", lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0), (quality_cnn.score_quality, "quality", lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1)])
def test_classifiers_on_held_out_rows(spark, odd, none, score, label, held):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = score(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(held)).all() and got["score"].between(0, 1).all()
    out = got[got["held_out"]]
    assert (out["predicted"] == out[label]).mean() > 0.93
    some = labels.limit(50).unionByName(labels.selectExpr("cast(null as bigint) as doc_id", "quality", "toxic").limit(3)).unionByName(labels.selectExpr("doc_id", "cast(null as int) as quality", "cast(null as int) as toxic").limit(3))
    assert score(odd, some).count() == odd.count() and score(odd, labels.limit(0)).count() == odd.count() and score(none, labels).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    """A shared id gives one training row, whole rows are left out beyond the byte bound, labels of others don't count."""
    docs = spark.range(60).selectExpr("if(id < 40, 7, id) as doc_id", "concat('text ', id, ' ', repeat('x', 100)) as text")
    labels = spark.range(60).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    rows = toxicity.training_rows(docs, labels, "quality", 3, 1, 1000).collect()
    expected = {i for i in [7, *range(40, 60)] if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    assert sorted(r["doc_id"] for r in rows) == sorted(expected)
    monkeypatch.setattr(quality_cnn, "SAMPLE_BYTES", 550)
    assert quality_cnn._bounded(spark.createDataFrame(rows)).count() == 5


def test_network_sees_every_chunk():
    """Gradients over slabs equal those in one piece and finite differences; a long text trains with all its chunks."""
    import numpy as np

    network = quality_cnn.Network()
    texts = [bytes(np.random.default_rng(k).integers(97, 123, 300 * (k + 1), dtype=np.uint8)) for k in range(40)]
    chunks = [network._chunks(t) for t in texts]
    assert [len(c) for c in chunks] == [max(2, -(-len(t) // 128)) - 1 for t in texts]
    data, counts, y = np.concatenate(chunks), np.array([len(c) for c in chunks]), (np.arange(40) % 2).astype(np.float32)
    whole = network._gradients(data, counts, y)
    before, quality_cnn.CHUNK_SLAB = quality_cnn.CHUNK_SLAB, 37
    try:
        cut = network._gradients(data, counts, y)
    finally:
        quality_cnn.CHUNK_SLAB = before
    assert all(np.allclose(whole[k], cut[k], atol=1e-5) for k in whole)

    def loss():
        p = np.clip(network.score(texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("u", 3), ("d", 0), ("c", 5)):
        ends = []
        for step in (1e-2, -2e-2):
            network.p[name][at] += step
            ends.append(loss())
        network.p[name][at] += 1e-2
        assert abs((ends[0] - ends[1]) / 2e-2 - whole[name][at]) < 2e-3


def test_empty_tables(spark, none, sample):
    bench = spark.read.parquet(f"{sample}/benchmark.parquet")
    for rows in (secret_scan.secret_report(none), repeats.remove_repeats(none), quality_rules.quality_verdicts(none), line_dedup.dedup_lines(none), minhash.near_duplicates(none), mixing.mixed(none),
                 decontaminate.decontaminate(none, bench), packing.pack_tokens(none), quality_rules.keep_good(none), minhash.keep_first(none), mixing.take_mixture(none), decontaminate.keep_clean(none, bench)):
        assert rows.count() == 0
    assert decontaminate.decontaminate(spark.read.parquet(f"{sample}/documents.parquet"), bench.limit(0)).where("contaminated").count() == 0


def test_pipeline_stages(spark, odd, sample):
    import corpus_pipeline

    docs = given(spark, sample)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        extra = stage(spark, odd, sample)
        assert k == 4 or extra.columns == odd.columns
        extra.count()
        after = stage(spark, docs, sample)
        assert k == 4 or set(r["doc_id"] for r in after.select("doc_id").collect()) <= set(r["doc_id"] for r in docs.select("doc_id").collect())
    assert corpus_pipeline.run(spark, sample).count() > 0
