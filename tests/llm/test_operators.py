"""Every operator against a brute-force version, on odd input and on empty tables."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from plumbline.llm import common, components, decontaminate, jaccard_join, language_id, line_dedup, lm_score, pii, quality, queries, secret_scan, sentencepiece, substring_dedup
from plumbline.llm import spans as S


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


# language ID


def test_language_held_out_accuracy(sample):
    model = language_id.fit(sample)
    rows = language_id.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_mixture_shares(spark, sample):
    model = language_id.fit(sample)
    own = {r["lang"]: r["text"][:1500] for r in sample.where("lang in ('en', 'de') and length(text) > 1500").collect()}
    both = spark.createDataFrame([(1, own["en"] + "\n" + own["de"])], "doc_id long, text string")
    found = language_id.predict(both, model).head()
    shares = dict(p.split(":") for p in found["lang_mix"].split(","))
    assert set(shares) == {"en", "de"} and all(0.3 < float(x) < 0.7 for x in shares.values())


def test_language_odd_input(odd, nothing, sample):
    model = language_id.fit(odd)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == 13
    found = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (1, 2, 3))
    assert found[6]["lang_pred"] in ("en", "fr")
    assert language_id.predict(nothing, language_id.fit(nothing)).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(nothing)).collect()} == {"und"}
    kept = language_id.keep_known(odd, language_id.fit(sample))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3})


def test_language_mixture_against_all_subsets(sample):
    """The language set and shares are those of the best of all subsets, by likelihood word by word less the penalty."""
    model = language_id.fit(sample)
    width = len(model.languages)
    rows = [r["text"] for r in sample.where("length(text) between 200 and 900").orderBy("doc_id").limit(24).collect()]
    rows += [a[:400] + " " + b[:300] for a, b in zip(rows, rows[12:], strict=False)]
    shares, known, fits = language_id.mixture(model, [x.encode() for x in rows])
    assert known.all()
    same = 0
    for text, got, fit in zip(rows, shares, fits, strict=True):
        words = "".join(c if c.isalpha() or not c.isascii() else " " for c in text.lower()).split()
        logs = [[0.0] * width for _ in words]
        for w, word in enumerate(words):
            data = b" " + word.encode() + b" "
            for i in range(len(data) - 2):
                bucket = ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 16
                for k in range(width):
                    logs[w][k] += float(model.table[bucket, k])
        like = [[math.exp(max(x - max(row), -30)) + 1e-6 for x in row] for row in logs]
        best = None
        for chosen in range(1, 2**width):
            share = [1 / bin(chosen).count("1") if chosen >> k & 1 else 0.0 for k in range(width)]
            for _ in range(60):
                total = [0.0] * width
                for row in like:
                    z = sum(a * b for a, b in zip(row, share, strict=True))
                    total = [t + a * b / z for t, a, b in zip(total, row, share, strict=True)]
                share = [t / len(like) for t in total]
            found = sum(math.log(sum(a * b for a, b in zip(row, share, strict=True))) for row in like)
            gain = found - 2.0 * math.log(len(words) + 1) * bin(chosen).count("1")
            if best is None or gain > best[0]:
                best = (gain, share, found)
        if all((a > 0) == (b > 0) for a, b in zip(best[1], got, strict=True)):
            same += 1
            assert max(abs(a - b) for a, b in zip(best[1], got, strict=True)) < 0.03
            trigrams = sum(len(x.encode()) for x in words)
            assert abs(fit - (sum(map(max, logs)) + best[2]) / trigrams) < 0.01
    assert same >= 0.9 * len(rows)


def test_language_rejects_what_no_mixture_explains(spark, sample):
    model = language_id.fit(sample)
    rng = random.Random(5)
    latin, coded = string.ascii_lowercase, string.ascii_letters + string.digits + "+/"
    strange = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 12))) for _ in range(n)) for letters in (latin, coded, "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5600)))) for n in (8, 80, 2000)]
    assert language_id.keep_known(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect() == []
    clean = sample.where("text rlike '[A-Za-z]'")
    assert language_id.keep_known(clean, model).count() == clean.count()
    # a label is still given to every text with a letter
    assert "und" not in {r["lang_pred"] for r in language_id.predict(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).collect()}


# line dedup


def _lines(rows):
    return {k: t for k, t in rows}


def test_lines_generalise_variable_fields(spark):
    texts = [(i, f"{prose(i, 30)}\nVisit page {i} of the archive for more of this today\n{prose(100 + i, 30)}") for i in range(5)]
    texts += [(10 + i, f"{prose(200 + i, 30)}\nthis site uses cookies and {w} will always respect your choice\n{prose(300 + i, 30)}") for i, w in enumerate(["anna", "bert", "carl", "dora"])]
    texts += [(20, f"{prose(400, 30)}\nseen in two only\n"), (21, f"{prose(401, 30)}\nseen in two only\n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = by_id(line_dedup.dedup(docs), "text", "__n_lines", "__n_dropped")
    for i in list(range(5)) + list(range(10, 14)):
        lines = dict(texts)[i].split("\n")
        assert found[i] == (f"{lines[0]}\n{lines[2]}", 3, 1)
    assert found[20] == (dict(texts)[20], 3, 0)


def test_lines_end_tokens_at_spaces_only(spark):
    texts = [(i, f"{prose(i, 40)}\n{w}\ttwo{i} three\r\n{w}{i}\tthe same tail here\r") for i, w in enumerate(["anna", "bert", "carl", "dora"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # "anna<tab>two0" and "anna0<tab>the" are single tokens with a digit, so variable fields
    assert by_id(line_dedup.dedup(docs), "text", "__n_dropped") == {i: (t.split("\n")[0], 2) for i, t in texts}


def test_lines_of_a_very_long_text(spark):
    long = [f"own line {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}" if i % 3 else "many have this line" for i in range(9000)]
    short = [(k, f"{prose(k, 20)}\nmany have this line\n{prose(50 + k, 20)}") for k in range(2, 6)]
    docs = spark.createDataFrame([(1, "\n".join(long)), *short], "doc_id long, text string")
    found = by_id(line_dedup.dedup(docs), "text", "__n_lines", "__n_dropped")
    assert found[1] == ("\n".join(x for x in long if x.startswith("own")), 9000, 3000)


def test_lines_of_exact_copies_are_one_and_all_recurring_lines_go(spark):
    copies = [(i, prose(1, 40) + "\n" + prose(2, 40)) for i in range(6)]
    near = [(10 + i, f"{prose(3, 40)}\n{prose(4, 40)}\nown line of {'abcd'[i]} alone {'efgh'[i]}") for i in range(4)]
    docs = spark.createDataFrame(copies + near, "doc_id long, text string")
    found = by_id(line_dedup.dedup(docs), "text", "__n_dropped")
    assert all(found[i] == (t, 0) for i, t in copies)
    assert all(found[i] == (t.split("\n")[2], 2) for i, t in near)  # over half of each text
    first = by_id(line_dedup.dedup(docs, keep_first=True), "text", "__n_dropped")
    assert first[10] == (near[0][1], 0) and all(first[i] == found[i] for i in (11, 12, 13)) and all(first[i] == (t, 0) for i, t in copies)


def _brute_lines(rows, min_docs=3):
    def templates(line):
        t = ["<*>" if re.search("[0-9]", x) else x for x in line.strip(" ").split(" ")]
        if t == [""]:
            return []
        half = (len(t) - 3) // 2
        if len(t) < 8:
            return [("all", *t)]
        return [("first", len(t), *t[: 3 + half]), ("second", len(t), *t[:3], "|", *t[3 + half :])]

    holders = {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            for t in templates(line):
                holders.setdefault(t, set()).add(text)
    often = {t for t, own in holders.items() if len(own) >= min_docs}
    return {k: text and "\n".join(x for x in text.split("\n") if not often.intersection(templates(x))) for k, text in rows}


@pytest.mark.parametrize("partitions", ["2", "40"])  # with 40, common templates are cut in pieces
def test_lines_match_brute_force(spark, sample, partitions):
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    rows += [(10_000 + i, f"{prose(i, 9)}\nmenu home about\n{prose(500 + i, 12)}\nseen on {i} days by all of our readers here") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {k: (t,) for k, t in _brute_lines(rows).items()}


def test_lines_and_classes_leave_clashing_columns_alone(spark):
    names = ["__text", "__doc", "__node", "__hit", "__kept", "__n_lines", "__piece", "row", "digest", "gone", "hit_doc", "root", "template", "key", "rows", "first"]
    rows = [(i, f"{prose(i % 4, 30)}\nthe same line in all", *[f"{n}{i}" for n in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    cut = line_dedup.dedup(docs)
    assert cut.columns == [*docs.columns, "__n_lines_", "__n_dropped"]
    assert {r["doc_id"]: tuple(r)[2 : 2 + len(names)] for r in cut.collect()} == {r[0]: r[2:] for r in rows}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == set(rows[:4])


def _ledger(spark, tmp_path):
    return secret_scan.Ledger(spark, str(tmp_path / "ledger"))


def test_native_operators_have_no_python(spark, sample, tmp_path):
    for frame in (line_dedup.dedup(sample), secret_scan.report(sample, _ledger(spark, tmp_path)), pii.extract(sample)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


# n-gram Jaccard join


def _sets(text):
    words = (text or "").encode().translate(common.LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _brute_classes(rows):
    ids = [k for k, t in rows if _sets(t)]
    text = dict(rows)
    sets = {k: _sets(text[k]) for k in ids}
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {k: set() for k in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
                if text[a] != text[b]:
                    links[a].add(text[b])
                    links[b].add(text[a])
    return {k: (find(k), len(links[k])) for k in ids}


def _near(seed, edits, n=120):
    words = prose(seed, n).split()
    for e in range(edits):
        words[(e * 29 + edits * 7) % n] = f"edit{seed}{e}"
    return " ".join(words)


def test_jaccard_matches_brute_force(spark):
    rows = [(i, _near(i % 7, i % 5)) for i in range(60)] + [(100, "a b c"), (101, "A B  c"), (102, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard_join.classes(docs), "class_id", "n_links") == _brute_classes(rows)


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = [(i, _near(1, 0, 200) + f" tail{i}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(jaccard_join.classes(docs), "class_id", "n_links", "n_copies")
    assert found == {i: (0, 69, 0) for i in range(70)}
    kept = jaccard_join.keep_one(docs).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_jaccard_sample(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert by_id(jaccard_join.classes(sample), "class_id", "n_links") == _brute_classes(rows)


def test_jaccard_odd_input(odd, nothing):
    rows = jaccard_join.classes(odd).collect()
    assert len(rows) == 13
    found = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert found[5]["class_id"] == 4 and found[4]["n_copies"] == 2 and found[4]["n_links"] == 0
    assert found[2]["class_id"] == 2 and found[3]["class_id"] == 3 and found[1]["n_copies"] == 0
    assert jaccard_join.classes(nothing).collect() == []
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", *map(str, [1, 2, 3, 4, 6, 7, 8, 9, 10])])


def test_pruning_rule():
    least = jaccard_join.least_matches()
    assert all(least[n] < 0.8 * n for n in least) and list(least.values()) == sorted(least.values())
    # a pair at the threshold is dropped with a probability near the tolerance
    n, m, t = 128, least[128], 0.8 + 0.2 / 256
    assert sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(m)) < 1e-5


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# benchmark decontamination


def _brute_hits(docs, items):
    windows = {}
    for name, text in items:
        w = decontaminate.words_of((text or "").encode())
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    out = {}
    for k, text in docs:
        w, hit, names = decontaminate.words_of((text or "").encode()), set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    names |= own
        out[k] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 20])
def test_decontamination_matches_brute_force(spark, limit):
    items = [("1", prose(1, 40)), ("2", prose(2, 10)), ("10", "short ITEM here"), ("3", prose(1, 40)), ("4", None), ("5", "..."), ("6", "a a a a a a a a a a a a")]
    docs = [(1, prose(50, 30) + " " + prose(1, 40)[30:200] + " " + prose(51, 30)), (2, prose(2, 10).upper()), (3, "it is a Short item, here!"), (4, None), (5, ""), (6, "a " * 30), (7, prose(1, 9)), (8, prose(60, 200))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.find(d, b, limit)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"), (hit > 0).alias("bad"))
    want = _brute_hits(docs, items)
    assert by_id(rows, "n_words", "n_hit", "n", "sha", "bad") == want
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(d, b, limit).collect()} == {k for k, v in want.items() if not v[4]}


def test_decontamination_odd_input(spark, odd, nothing):
    b = spark.createDataFrame([(1, "one two"), (2, "something else")], "item_id long, text string")
    none = b.limit(0)
    for limit in (decontaminate.BROADCAST_WORDS, 1):
        rows = decontaminate.find(odd, b, limit).collect()
        assert len(rows) == 13 and {r["doc_id"] for r in rows if r["items"]} == {8}
        assert decontaminate.find(nothing, b, limit).collect() == []
        assert decontaminate.drop_contaminated(odd, b, limit).count() == 12
    assert all(not r["items"] for r in decontaminate.find(odd, none).collect())
    assert decontaminate.find(nothing, b).collect() == []
    assert decontaminate.drop_contaminated(odd, b).count() == 12


# SentencePiece


@pytest.fixture(scope="module")
def pieces(spark):
    return sentencepiece.load(spark)


def _best(p, text):
    """Brute force: the best score of any cut, by a dictionary."""
    names = {p.text[i]: float(p.score[i]) for i in range(len(p.text)) if p.kind[i] in (1, 4)}
    best = [0.0] + [-math.inf] * len(text)
    for a in range(len(text)):
        if best[a] == -math.inf:
            continue
        size = len(text[a:].decode("utf-8", "ignore")[:1].encode())
        if text[a : a + size] not in names:
            best[a + size] = max(best[a + size], best[a] + p.unknown)
        for b in range(a + 1, min(len(text), a + p.longest) + 1):
            if text[a:b] in names:
                best[b] = max(best[b], best[a] + names[text[a:b]])
    return best[-1]


def _worth(p, ids):
    score, run = 0.0, b""
    for i in [*ids, None]:
        if i is not None and p.kind[i] == 6:
            run += p.text[i]
            continue
        score += p.unknown * len(run.decode())
        run = b""
        score += 0 if i is None else float(p.score[i])
    return score


def test_pieces_are_optimal_and_come_back(pieces, sample):
    encoder = sentencepiece.Encoder(pieces)
    texts = [r["text"][:400].encode() for r in sample.limit(40).collect()] + ["é😀 ▁x  \n\n\ty".encode(), b"  two  spaces ", b"a" * 200]
    ids, counts = encoder.encode(texts)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        own = ids[at : at + n].tolist()
        at += n
        assert sentencepiece.decode_ids(pieces, own) == t
        assert _worth(pieces, own) == pytest.approx(_best(pieces, b" " + t))


def test_pieces_odd_input(odd, odd_rows, nothing, pieces):
    rows = sentencepiece.round_trip(odd, pieces).collect()
    assert len(rows) == 13 and all(r["exact"] for r in rows)
    assert all((r["ids"] is None) == (r["doc_id"] == 1 or (r["doc_id"] is None and r["n_pieces"] == 0)) for r in rows)
    back = sentencepiece.decode(sentencepiece.encode(odd, pieces), pieces)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(str((a, b)) for a, b, *_ in odd_rows)
    assert sentencepiece.round_trip(nothing, pieces).collect() == []


def test_one_by_one_is_the_same(pieces):
    units = [f" {w}".encode() for w in prose(5, 300).split()] + ["é▁ß".encode(), b"   x"]
    ids, counts = sentencepiece.viterbi(pieces, units)
    assert ids.tolist() == [i for u in units for i in sentencepiece.viterbi_long(pieces, u)]
    assert counts.tolist() == [len(sentencepiece.viterbi_long(pieces, u)) for u in units]


# quality


def _brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_base_counts_and_held_out(spark, sample, odd, odd_rows, nothing):
    for frame, rows in ((sample, [(r["doc_id"], r["text"]) for r in sample.collect()]), (odd, [(a, b) for a, b, *_ in odd_rows if a])):
        found = by_id(quality.judge(frame, None), *BASE)
        assert {k: v for k, v in found.items() if k is not None} == {k: _brute_statistics(t) for k, t in rows}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    rows = quality.judge(docs.where("doc_id % 2 = 1"), trees).join(labels, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.9 * len(rows)
    assert quality.fit(docs, labels.limit(0)) is None and quality.judge(nothing, trees).collect() == []


def test_quality_is_monotone():
    import numpy as np

    r = np.random.default_rng(3)
    x = r.random((400, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * r.standard_normal(400) > 0.5).astype(float)  # the data say up, the rule says down
    k = quality.FEATURES.index("symbol_rate")
    trees = quality.boost(x, y, monotone={k: -1, 4: 1})
    for f, sign in ((k, -1), (4, 1)):
        probe = np.repeat(x[:50], 20, axis=0)
        probe[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(trees.score(probe).reshape(50, 20), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_quality_scores_match_a_plain_tree_walk():
    import numpy as np

    r = np.random.default_rng(8)
    x = r.random((300, len(quality.FEATURES))).round(2)  # ties with the thresholds
    trees = quality.boost(x, (x[:, 0] + x[:, 3] > 1).astype(float))

    def walk(row) -> float:
        total = trees.start
        for k in trees.root.tolist():
            while trees.feature[k] >= 0:
                k = int(trees.left[k]) + (0 if row[trees.feature[k]] <= trees.threshold[k] else 1)
            total += trees.value[k]
        return 1 / (1 + math.exp(-total))

    assert trees.score(x) == pytest.approx([walk(row) for row in x], rel=1e-9)
    assert len(set(trees.score(x).round(6))) > 10


# language-model scoring


def test_lm_base_is_exact_and_model_is_better(sample, odd, nothing, monkeypatch):
    monkeypatch.setattr(lm_score, "BROADCAST", 512)
    docs = {r["doc_id"]: lm_score.tokens_of(r["text"].encode()) for r in sample.collect()}
    counts = Counter(t for k, w in docs.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in w)
    n, v = sum(counts.values()), len(counts)
    model, table = lm_score.fit(sample, lm_score.train_rows())
    rows = lm_score.score(sample, model, table, ~lm_score.train_rows()).collect()
    for r in rows:
        w = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w))
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    model, table = lm_score.fit(odd, lm_score.train_rows())
    rows = lm_score.score(odd, model, table, ~lm_score.train_rows()).collect()
    assert len(rows) == 13 and {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"]}[1] == 1
    model, table = lm_score.fit(nothing, lm_score.train_rows())
    assert lm_score.score(nothing, model, table, ~lm_score.train_rows()).collect() == []
    assert all(r["n_known"] == 0 for r in lm_score.score(sample.limit(3), model, table, ~lm_score.train_rows()).collect())


def test_lm_scores_do_not_depend_on_partitions(sample, odd):
    for frame in (sample, odd):
        one, many = frame.coalesce(1), frame.repartition(64)
        found = []
        for part, other in ((one, many), (many, one)):
            model, table = lm_score.fit(part, lm_score.train_rows())
            found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"], r["base_score"]) for r in lm_score.score(other, model, table, ~lm_score.train_rows()).collect()))
        for a, b in zip(*found, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-6)


def test_lm_softmax_and_gradient_match_brute_force(sample):
    import numpy as np

    model, _ = lm_score.fit(sample, lm_score.train_rows())
    ranks = lm_score._Ranks(model.keys)
    ids, features, _ = lm_score._numbers(ranks, [r["text"].encode()[:300] for r in sample.limit(3).collect()])
    found = lm_score.log_probability(model, ids, features)
    sums = [*lm_score._tables(), np.zeros(lm_score.CLASS_ROWS, np.int64), np.zeros(lm_score.WORD_ROWS, np.int64)]
    lm_score.gradient(model, ids, features, tuple(sums))
    moved = np.zeros((lm_score.CLASS_ROWS, lm_score.CLASSES))
    for i, w in enumerate(ids.tolist()):
        c = w // lm_score.CLASS if w < model.listed else lm_score.CLASSES - 1
        rows = [int(lm_score._rows(np.array([f]), lm_score.CLASS_ROWS)[0]) for f in features[i]]
        logits = [float(model.class_bias[k]) + sum(float(model.class_weight[r, k]) for r in rows) for k in range(lm_score.CLASSES)]
        total = sum(math.exp(x) for x in logits)
        want = logits[c] - math.log(total)
        if w < model.listed:
            own = [int(lm_score._rows(np.array([f]), lm_score.WORD_ROWS, np.array([c + 1]))[0]) for f in features[i]]
            inner = [float(model.word_bias[c, k]) + sum(float(model.word_weight[r, k]) for r in own) for k in range(lm_score.CLASS)]
            want += inner[w % lm_score.CLASS] - math.log(sum(math.exp(x) for x in inner))
        assert found[i] == pytest.approx(want, abs=1e-4)
        for r in rows:
            for k in range(lm_score.CLASSES):
                moved[r, k] += math.exp(logits[k]) / total - (k == c)
    assert np.abs(sums[0] / lm_score.STEPS - moved).max() < 1e-2
    assert sums[2].sum() == 2 * len(ids)


def test_lm_gain_on_documents_without_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(64)
    model, table = lm_score.fit(docs, lm_score.train_rows())
    rows = lm_score.score(docs, model, table, ~lm_score.train_rows()).join(docs, "doc_id").collect()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [lm_score.tokens_of(t.encode())] for i in range(len(w) - 4)}
    seen = set().union(*(grams(r["text"]) for r in rows if not r["held_out"]))
    for chosen in ([r for r in rows if r["held_out"]], [r for r in rows if r["held_out"] and not grams(r["text"]) & seen]):
        assert chosen and sum(r["score"] - r["base_score"] for r in chosen) >= 0.05 * sum(r["n_tokens"] for r in chosen)


def test_lm_probabilities_sum_to_one(sample):
    import numpy as np

    model, _ = lm_score.fit(sample, lm_score.train_rows())
    features = np.array([[5 + 2 * 3, 6 + 2 * 9]])
    n = model.listed
    own = lm_score.log_probability(model, np.arange(n), np.repeat(features, n, axis=0))
    rest = lm_score.log_probability(model, np.array([n]), features)
    assert np.exp(own).sum() + np.exp(rest).sum() == pytest.approx(1, abs=1e-4)


# personal data and secrets


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: _luhn(m.group())),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m.group()) <= 15),
]
SECRET_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
]
ODD_TEXTS = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256", "+1 (017) 555-7713", "😀 a@b.co 4111 1111 1111 1111 4111-1111-1111-1111 +12345678", "", None, "1" * 20000, "1 " * 20000, "a" * 50000, "password: hunter2hunter2 PASSWORD=\"abcd\" apikey=12345678 api_key : 'zzzzzzzz' token==abcdefgh", "AKIAAKIA12345678901 AKIA123", "x" + "0123456789abcdef" * 3 + "g" + "ab" * 15, ".".join(["1"] * 5001), "a@" * 10000, "token token=token=token=abcdefghi"]


def _brute_spans(text, rules):
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)


#: Many more matches than one chunk holds; other matches and contexts lie between them.
LONG_TEXT = "\n".join(f"é😀 write to u{i}@ex{i % 9}.com or 10.0.{i % 300}.7 now, token={i:08d}x and AKIA{i:016d} call +1 (555) 010 {i:04d} ext {i}" for i in range(1500))


@pytest.mark.parametrize("size", [0, 1, S.CHUNK - 1, S.CHUNK, S.CHUNK + 1, 3 * S.CHUNK])
def test_chunks_hold_every_member_once(spark, size):
    row = spark.range(1).select(S.chunks(F.slice(F.sequence(F.lit(1), F.lit(1000)), 1, size)).alias("c")).head()
    assert [x for c in row["c"] for x in c] == list(range(1, size + 1)) and all(len(c) <= S.CHUNK for c in row["c"])


def test_long_text_has_no_discovery_on_base_spans(spark):
    docs = spark.createDataFrame([(1, LONG_TEXT)], "doc_id long, text string")
    row = pii.extract(docs).head()
    taken = [False] * len(LONG_TEXT)
    for s in row["__base"]:
        taken[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
    assert len(row["__base"]) > 20 * S.CHUNK and not any(any(taken[s["start"] : s["end"]]) for s in row["__found"])


@pytest.mark.parametrize("which", ["pii", "secrets"])
def test_base_spans_match_brute_force(spark, sample, which, tmp_path):
    texts = [(i, t) for i, t in enumerate([*ODD_TEXTS, LONG_TEXT])] + [(1000 + r["doc_id"], r["text"]) for r in sample.collect()]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    if which == "pii":
        found, rules = by_id(pii.extract(docs).select("doc_id", S.written(F.col("__base")).alias("s")), "s"), PII_RULES
    else:
        kinds = [r.kind for r in secret_scan.BASE]
        rows = secret_scan.report(docs, _ledger(spark, tmp_path))
        found, rules = by_id(rows.select("doc_id", S.written(F.filter("__spans", lambda s: s["kind"].isin(kinds))).alias("s")), "s"), SECRET_RULES
    assert found == {k: (_brute_spans(t, rules),) for k, t in texts}


def test_pii_contexts_discover_identifiers(spark):
    seeds = [(i, f"{prose(i, 20)} please call me at +1 (555) 010-{1000 + i} today. {prose(50 + i, 5)}") for i in range(6)]
    hidden = [(10, f"{prose(60, 20)} please call me at 555-010-2222 today. ok"), (11, f"{prose(61, 20)} room 5550102222 north")]
    docs = spark.createDataFrame(seeds + hidden, "doc_id long, text string")
    found = by_id(pii.extract(docs).select("doc_id", S.written(F.col("__found")).alias("s")), "s")
    at = hidden[0][1].index("555-010")
    assert found[10] == (f"phone:{at}:{at + 12}",) and found[11] == ("",) and all(found[i] == ("",) for i in range(6))


def test_pii_is_discovered_beside_base_spans(spark):
    seeds = [(i, f"{prose(i, 20)} mail u{i}@ex.com +1 (555) 010-{1000 + i} today. {prose(50 + i, 5)}") for i in range(6)]
    hidden = [(10, "mail jane@ex.com 030 1234567 today. ok"), (11, f"{prose(61, 9)} mail jane@ex.com, 030 7654321 today."), (12, "a@b.co 030 7777777")]
    found = by_id(pii.extract(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).select("doc_id", S.written(F.col("__found")).alias("s")), "s")
    for k, number in ((10, "030 1234567"), (11, "030 7654321")):
        at = dict(hidden)[k].index(number)
        assert found[k] == (f"phone:{at}:{at + len(number)}",)
    assert all(found[i] == ("",) for i in (*range(6), 12))


def test_pii_discovered_instances_support_new_patterns(spark):
    seeds = [(i, f"please call me at +1 (555) 010-{1000 + i} today.") for i in range(9)]
    found_once = [(20 + i, f"please call me at 555-020-{2000 + i} today.") for i in range(4)]
    again = [(30 + i, f"reach our desk via 555-020-{2000 + i} anytime.") for i in range(4)]
    docs = spark.createDataFrame([*seeds, *found_once, *again, (40, "reach our desk via 555-030-9999 anytime.")], "doc_id long, text string")
    found = by_id(pii.extract(docs).select("doc_id", S.written(F.col("__found")).alias("s")), "s")
    assert found[20] == ("phone:18:30",) and found[30] == ("phone:19:31",) and found[40] == ("phone:19:31",)


def test_pii_and_secrets_odd_input(spark, odd, nothing, tmp_path):
    for name in ("op1_pii", "op10_secret_scan"):
        assert name in queries.QUERIES
    rows = pii.extract(odd).collect()
    assert len(rows) == 13 and pii.extract(nothing).collect() == []
    rows = secret_scan.report(odd, _ledger(spark, tmp_path)).collect()
    assert len(rows) == 13 and secret_scan.report(nothing, secret_scan.Ledger(spark, str(tmp_path / "none"))).collect() == []


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, "plain")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "token=abcdefgh1"), (5, "secret: zyxwvuts")], "doc_id long, text string")
    ledger = _ledger(spark, tmp_path)
    assert by_id(secret_scan.report(one, ledger).select("doc_id", S.written(F.col("__spans")).alias("s")), "s") == {1: ("assign:0:15",), 2: ("assign:0:15",), 3: ("",)}
    assert ledger.rows().select("blob").distinct().count() == 2
    blobs = two.select(secret_scan.address(F.col("text")).alias("blob"))
    todo = secret_scan.unseen(blobs, ledger.rows())
    assert todo.count() == 1 and len(todo.head()["todo"]) == len(secret_scan.RULES)
    for few in (secret_scan.FEW, 0):  # by a broadcast and by a shuffle
        monkeypatch.setattr(secret_scan, "FEW", few)
        assert secret_scan.scan(two, todo).count() == len(secret_scan.RULES)
    found = secret_scan.report(two, ledger)
    assert by_id(found.select("doc_id", S.written(F.col("__spans")).alias("s")), "s") == {4: ("assign:0:15",), 5: ("assign:0:16",)}
    assert secret_scan.unseen(blobs, ledger.rows()).count() == 0
    newer = [secret_scan.Rule("assign", secret_scan.ASSIGN, secret_scan._always, secret_scan._always, version=2), *secret_scan.RULES[1:]]
    again = secret_scan.scan(two, secret_scan.unseen(blobs, ledger.rows(), newer), newer)
    assert {r["rule"] for r in again.collect()} == {"assign@2"} and again.count() == 2


def test_secret_and_pii_columns_match_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for name, rules in (("op1_pii", PII_RULES), ("op10_secret_scan", SECRET_RULES)):
        for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect():
            spans = _brute_spans(docs[r["doc_id"]], rules)
            assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
            assert [r[f"n_{n}"] for n, *_ in rules] == [sum(x.startswith(f"{n}:") for x in spans.split(",")) for n, *_ in rules]
            assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


# substring dedup


def test_passages_are_found_exact_and_fuzzy(spark):
    shared, words = prose(1, 60), prose(2, 80).split()
    fuzzy = list(words)
    fuzzy[20], fuzzy[41] = "changed", "other"
    del fuzzy[60]
    rows = [(i, f"{prose(10 + i, 40)} {shared} {prose(30 + i, 40)}") for i in range(4)]
    rows += [(10, f"{prose(50, 30)} {' '.join(words)}"), (11, f"{' '.join(fuzzy)} {prose(51, 30)}"), (12, prose(52, 300))]
    found = {(r["doc_id"], r["ref_doc_id"]): r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 0), (2, 0), (3, 0), (11, 10)} <= set(found) <= {(a, b) for a in range(4) for b in range(a)} | {(11, 10)}
    assert all(found[i, 0]["start_word"] <= 40 and found[i, 0]["end_word"] >= 100 for i in (1, 2, 3))
    near = found[11, 10]
    assert near["start_word"] <= 1 and near["end_word"] >= 78 and 0.9 < near["identity"] < 1


@pytest.mark.parametrize(("size", "every"), [(60, 9), (60, 10), (60, 12), (60, 15), (100, 10), (40, 12)])
def test_passages_with_evenly_spread_edits_are_found(spark, size, every):
    rows = []
    for k in range(40):
        words = prose(1000 + k, size).split()
        edited = [f"edit{k}x{i}" if i % every == every - 1 else w for i, w in enumerate(words)]
        rows += [(2 * k + n, f"{prose(2000 + 2 * k + n, 60)} {' '.join(w)} {prose(3000 + 2 * k + n, 60)}") for n, w in enumerate((words, edited))]
    found = {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2 * k + 1, 2 * k) for k in range(40)} <= found


def test_passages_are_found_at_every_occurrence(spark):
    shared = prose(1, 50)
    often = " ".join(f"{prose(20 + i, 40)} {shared}" for i in range(5))
    # the first document has half of the passage before the whole of it
    half = f"{' '.join(shared.split()[:25])} {prose(40, 80)} {shared}"
    edited = shared.split()
    edited[12] = edited[37] = "edit"
    rows = [(1, f"{prose(10, 40)} {shared} {prose(11, 40)}"), (2, often)]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    starts = sorted(r["start_word"] for r in found)
    assert [(r["doc_id"], r["ref_doc_id"]) for r in found] == [(2, 1)] * 5 and all(abs(s - (40 + 90 * i)) <= 4 for i, s in enumerate(starts))
    rows = [(1, half), (2, f"{prose(12, 40)} {' '.join(edited)} {prose(13, 40)}")]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r["start_word"] <= 41 and r["end_word"] >= 89 and r["ref_start"] <= 106 for r in found)


def test_passages_are_not_hidden_by_phrases_of_an_earlier_document(spark):
    shared = prose(1, 40).split()
    # all 8-mers of the passage, in pieces of 12 words too short to be reported
    phrases = " ".join(f"{' '.join(shared[i : i + 12])} {prose(50 + i, 100)}" for i in range(0, 40, 5))
    rows = [(1, phrases), *((k, f"{prose(10 + k, 40)} {' '.join(shared)} {prose(20 + k, 40)}") for k in (2, 3, 4))]
    found = {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(3, 2), (4, 3)} == found


def test_passages_next_to_each_other_are_both_found(spark):
    one, two = prose(1, 40).split(), prose(2, 40).split()
    edited = [f"edit{i}" if i >= 8 and i % 6 == 1 else w for i, w in enumerate(two)]
    rows = [(1, f"{prose(10, 30)} {' '.join(two)} {prose(11, 90)} {' '.join(one)} {prose(12, 30)}"), (2, f"{prose(13, 30)} {' '.join(one)} {' '.join(edited)} {prose(14, 30)}")]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 2 and {r["ref_start"] > 100 for r in found} == {True, False}


def test_passages_link_all_that_share_fifty_words(sample):
    words = {r["doc_id"]: r["text"].encode().translate(common.LOWER).split() for r in sample.collect()}
    parent = {k: k for k in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in substring_dedup.passages(sample).collect():
        parent[find(r["doc_id"])] = find(r["ref_doc_id"])
    first = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            assert find(first.setdefault(tuple(w[i : i + 50]), k)) == find(k)


def test_passages_odd_input(odd, nothing):
    found = {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.passages(odd).collect()}
    assert found == {(5, 4)}
    assert substring_dedup.passages(nothing).collect() == []


@pytest.mark.parametrize("edits", ["none", "changed", "longer"])
def test_passages_are_not_hidden_by_the_first_and_the_preceding_holder(spark, edits):
    words = prose(1, 40).split()
    phrases = lambda seed: " ".join(f"{' '.join(words[i : i + 12])} {prose(seed + i, 70)}" for i in range(0, 40, 5))
    other = {"none": words, "changed": [f"edit{i}" if i in (10, 25) else w for i, w in enumerate(words)], "longer": [*words[:20], "new", *words[20:]]}[edits]
    # all seeds of the passage are in the first and in the third document too, in pieces too short to be reported
    rows = [(1, phrases(100)), (2, f"{prose(10, 40)} {' '.join(words)} {prose(11, 40)}"), (3, phrases(300)), (4, f"{prose(12, 40)} {' '.join(other)} {prose(13, 40)}")]
    found = [(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert found == [(4, 2)]


@pytest.mark.parametrize("small", [0, substring_dedup.SMALL])
def test_seeds_of_very_many_documents_meet_where_a_passage_may_be(monkeypatch, small):
    monkeypatch.setattr(substring_dedup, "SMALL", small)
    phrase, tail = prose(1, 14).split(), prose(2, 30).split()
    texts = [prose(100 + i, 60).split() + phrase + prose(400 + i, 60).split() for i in range(60)]
    planted = {(11, 10): tail, (21, 20): [*tail[:4], "edit", *tail[5:]], (31, 30): [*tail[:9], "new", *tail[9:]], (41, 40): ["edit", *tail[1:]], (51, 50): [*tail[:2], "edit", *tail[3:9], "edit", *tail[10:16], "edit", *tail[17:]]}
    for (d, r), changed in planted.items():
        own = [f"{w}{r}" for w in tail]
        texts[r][74:104], texts[d][74:104] = own, [f"{w}{r}" for w in changed][:30]
    hashed = substring_dedup.word_hashes([" ".join(t).encode() for t in texts], common.WordHash())
    _, _, near = zip(*((i, *substring_dedup.surroundings(np.frombuffer(w, np.uint16), np.array([62]))) for i, w in enumerate(hashed)), strict=True)
    n, none = len(texts), np.zeros(len(texts), bool)
    i, j, _, _ = substring_dedup.hidden(np.zeros(n, np.int64), np.arange(n), np.arange(n), none, np.full(n, 62), np.concatenate(near))
    assert set(planted) == set(zip(i.tolist(), j.tolist(), strict=True))
    # those that lie in passages of one class already are settled
    assert not len(substring_dedup.hidden(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), ~none, np.full(n, 62), np.concatenate(near))[0])


@pytest.mark.parametrize("small", [0, substring_dedup.SMALL])
def test_phrases_too_short_for_a_passage_make_few_pairs(monkeypatch, small):
    monkeypatch.setattr(substring_dedup, "SMALL", small)
    # all have one phrase, and at a distance of its own another, which are too few words together
    phrase, other, own = prose(1, 14).split(), prose(2, 6).split(), lambda i, n: [f"own{i}x{k}" for k in range(n)]
    texts = [own(i, 60) + phrase + own(1000 + i, 4 + i % 12) + other + own(2000 + i, 60) for i in range(120)]
    # in the last two the phrase goes on, behind a word that one of them lacks
    tail = prose(3, 30).split()
    texts += [own(3000, 60) + phrase + tail + own(3001, 60), own(3002, 60) + phrase + tail[:9] + ["new", *tail[9:]] + own(3003, 60)]
    hashed = substring_dedup.word_hashes([" ".join(t).encode() for t in texts], common.WordHash())
    near = np.concatenate([substring_dedup.surroundings(np.frombuffer(w, np.uint16), np.array([62]))[1] for w in hashed])
    n = len(texts)
    i, j, _, _ = substring_dedup.hidden(np.zeros(n, np.int64), np.arange(n), np.arange(n), np.zeros(n, bool), np.full(n, 62), near)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    # words are compared by bytes there, so a few of 7 000 pairs seem to agree in more
    assert (121, 120) in pairs and len(pairs) < n


def test_equal_occurrences_in_two_documents_are_matched_one_by_one():
    words = prose(1, 125)
    near = substring_dedup.surroundings(np.frombuffer(substring_dedup.word_hashes([words.encode()], common.WordHash())[0], np.uint16), np.array([60]))[1]
    # 40 occurrences in one document and 30 in another
    doc, pos = np.repeat([0, 1], [30, 40]), np.append(np.arange(30), np.arange(40)) * 200
    i, j, _, _ = substring_dedup.hidden(np.zeros(70, np.int64), doc, doc, np.zeros(70, bool), pos, np.repeat(near, 70, axis=0))
    assert sorted(zip(pos[i].tolist(), pos[j].tolist(), strict=True)) == [(200 * k, 200 * min(k, 29)) for k in range(40)] and set(doc[i].tolist()) == {1}


def test_marked_rows_are_all_that_are_wanted_and_few_others(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k").selectExpr("k", "k as v")
    found = {r["k"]: r["v"] for r in substring_dedup.marked(rows, "k", rows.where("k % 10 = 3").selectExpr("k", "1 as rows")).collect()}
    assert set(range(3, 20_000, 10)) <= set(found) and len(found) < 2_200 and all(k == v for k, v in found.items())
