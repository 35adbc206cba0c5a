"""The numbered operators against brute force, on texts of every awkward kind."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from memlattice.llm import exact_dedup, langid, neardup, ngram_lm, packing, rans_store, sharding, viterbi_pieces
from memlattice.llm.wordbpe import WordBpe, default_vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.fixture(scope="session")
def plain():
    tokenizer = WordBpe(default_vocabulary()).tokenizer
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


# --- 10: exact dedup


def test_exact_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {max(v) for v in groups.values()}


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_exact_duplicates_go_by_row(spark):
    df = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 2), (1, "b", 3), (3, "c", 5), (3, "c", 4), (None, "d", 6), (None, "d", 7), (5, None, 8), (5, "", 9), (6, "e", 0)], "doc_id long, text string, _p int"
    )
    got = exact_dedup.drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r._p for r in got.collect() if r.doc_id != 5) == [0, 2, 3, 4, 6]
    assert [r.doc_id for r in got.collect()].count(5) == 1


def test_whole_texts_are_hashed_for_survivors_only(docs):
    """No plan that decides on duplicates hashes a text before its length and beginning were met twice."""
    rows = exact_dedup.refined(docs.selectExpr("doc_id", "coalesce(text, '') AS _t"))
    assert "sha2" not in rows._jdf.queryExecution().optimizedPlan().toString()
    plan = exact_dedup.equal_groups(rows.where("_close").selectExpr("doc_id", "sha2(encode(_t, 'UTF-8'), 256) AS _sha"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "isnotnull(sha2" not in plan


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5: near duplicates


def shingles(text, width):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, width):
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    want = components(sets, 80)
    got = neardup.near_duplicates(docs, width, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)
    kept = neardup.drop_near_duplicates(docs, width, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, c in want.items() if i == c}


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    """Hot keys and large families are cut into blocks; the result is the same."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 2)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 40)
    want = components({i: shingles(t, 2) for i, t, *_ in rows}, 80)
    got = neardup.near_duplicates(docs, 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_go_by_row(spark):
    same, other = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4", "p o i u y t r e w q"
    rows = [(1, same, 1), (2, same + " 5", 2), (2, other, 3), (3, other, 4), (3, other, 5), (4, "", 6), (4, None, 7), (None, same, 8), (9, "x", 9), (9, "x", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    assert sorted(r._n for r in neardup.drop_near_duplicates(df, 5, 80).collect()) in ([1, 3, 6, 7, 8, 9], [1, 3, 6, 7, 8, 10])


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty, 2, 80).count() == 0


def test_pigeonhole_keys_find_every_pair_within_the_distance():
    plan = neardup.Plan()
    rng = np.random.default_rng(1)
    layout = plan.keys()
    for _ in range(300):
        a = rng.integers(0, 1 << 16, plan.symbols)
        b = a.copy()
        at = rng.choice(plan.symbols, plan.distance, replace=False)
        b[at] = rng.integers(0, 1 << 16, plan.distance)
        assert any((a[cols] == b[cols]).all() for _, cols in layout)
    assert plan.miss_rate(0.8) < 1e-4


# --- 4: packing


def check_packing(got, lengths, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, n in lengths.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-n // capacity)))
        assert sum(p.length for p in parts) == n and all(p.length == capacity for p in parts[:-1])
        assert [p.start for p in parts] == [capacity * p.piece for p in parts]
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, rows, plain, capacity):
    got = packing.pack_documents(docs, capacity=capacity).collect()
    ids = {i: [*plain(t), 0] for i, t, *_ in rows}
    n = check_packing(got, {i: len(x) for i, x in ids.items()}, capacity)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert n <= math.ceil(sum(map(len, ids.values())) / capacity * 1.1) + 1


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


def test_best_two_fit_replaces_the_smallest_by_a_tighter_pair():
    plan = packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert plan[0] == ({60: 1, 25: 1, 15: 1}, 1)  # 60 + 30 leaves 10; 25 + 15 fill 40 exactly
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = Counter(rng.integers(1, 200, 300).tolist())
        plan = packing.best_two_fit(lengths, 200)
        used = Counter()
        for pattern, times in plan:
            assert sum(n * k for n, k in pattern.items()) <= 200 and times > 0
            for n, k in pattern.items():
                used[n] += k * times
        assert used == lengths


# --- 1: language


def test_language_identification(spark, empty):
    alphabet = {"en": "the and with ing tion", "de": "der und sch keit ung", "fr": "les que eau oir ment"}
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = list(alphabet)[i % 3]
        parts = alphabet[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(30)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 ... 3", None), (1003, "the with", None), (1004, "the and " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.training_fold()).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:240]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1004].lang_pred == "en"
    assert {r.doc_id for r in langid.drop_unidentified(df).collect()} == set(got) - {1000, 1001, 1002}
    assert langid.identify(empty, langid.training_fold()).count() == 0


def test_language_against_a_plain_model(spark):
    """Counts, weights and the nearest centroid, letter by letter; held-out labels are never read."""
    rows = _speech()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = langid.Settings(dims=512, fit_rows=10_000)
    fold = [zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows]
    model = langid.fit(df.where(langid.training_fold()).where("lang IS NOT NULL AND text IS NOT NULL"), settings)

    def counts(text):
        raw = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (" " + text + " ").encode()]
        cells = Counter()
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            if (a, b) != (32, 32) and (b, c) != (32, 32):
                cells[((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> 23] += 1
        return cells

    learned = [counts(t) for (_, t, lang), own in zip(rows, fold, strict=True) if own and lang and t is not None]
    frequency = Counter(cell for c in learned for cell in c)
    idf = [math.log((1 + len(learned)) / (1 + frequency[k])) + 1 for k in range(512)]
    assert np.allclose(model.idf, idf, rtol=1e-4)
    got = {r.doc_id: r for r in langid.identify(df, langid.training_fold(), settings).collect()}
    for i, t, _ in rows:
        vector = np.zeros(512)
        for cell, n in counts(t or "").items():
            vector[cell] = math.log(1 + n) * idf[cell]
        if vector.any():
            cosine = model.centroids @ (vector / np.linalg.norm(vector))
            assert abs(got[i].score - min(max(cosine.max(), 0), 1)) < 1e-4
            assert cosine[[k for k, lang in enumerate(model.langs) if lang == got[i].lang_pred]].max() > cosine.max() - 1e-5
    other = [(i, t, lang if own else "xx") for (i, t, lang), own in zip(rows, fold, strict=True)]
    again = langid.identify(spark.createDataFrame(other, "doc_id long, text string, lang string"), langid.training_fold(), settings)
    assert {r.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_rejects_by_distance(spark):
    """Gibberish of any length goes, short and repeating texts of a learned language stay."""
    rng = random.Random(4)
    gibberish = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
    rows = _speech()
    junk = [(10_000 + i, gibberish(n, a), None) for i, (n, a) in enumerate((n, a) for n in (50, 500, 2000) for a in ("bcdfghjklmnpqrstvwxz", "абвгдежзийклмнопрсту", "abcdefghijklmnopqrstuvwxyz"))]
    short = [(20_000 + i, t, None) for i, t in enumerate([rows[0][1].split()[0], " ".join(rows[1][1].split()[:2]), "a", (rows[0][1].split()[0] + " ") * 800])]
    df = spark.createDataFrame(rows + junk + short, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in langid.identify(df, langid.training_fold()).collect()}
    assert all(got[i] for i, *_ in junk)
    assert not any(got[i] for i, t, _ in rows if t) and not any(got[i] for i, *_ in short[:2] + short[3:])


def test_language_drops_by_row(spark):
    rows = [(i, t, lang) for i, t, lang in _speech() if t]
    df = spark.createDataFrame([*rows, (rows[0][0], "12 34", None), (rows[0][0], "12 34", None), (None, "56", None), (None, rows[1][1], None)], "doc_id long, text string, lang string")
    kept = Counter(r.text for r in langid.drop_unidentified(df).collect())
    assert not {"12 34", "56"} & set(kept) and sum(kept.values()) == len(rows) + 1


def _speech():
    """Rows of two invented languages and a few without text."""
    rng = random.Random(8)
    syllables = {"en": ["the", "shing", "wor", "ath", "ing"], "fr": ["lou", "eau", "ment", "que", "oir"]}
    word = lambda lang: "".join(rng.choices(syllables[lang], k=rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(1, 200))), lang) for i, lang in enumerate(["en", "fr"] * 150)]
    return [*rows, (900, None, "en"), (901, "", "fr"), (902, "the shing", None)]


def test_language_needs_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in langid.identify(df, langid.training_fold()).collect()] == [("und", True)]


# --- 6: language model


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(docs, rows, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "GATHER", 500)
    got = {r.doc_id: r for r in ngram_lm.score_documents(docs, ngram_lm.training_fold(), order=order).collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t, *_ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in tokens[i])
    total, size = sum(count.values()), len(count)
    grams = lambda words, n: list(zip(*[([0] * (n - 1) + words)[k:] for k in range(n)], strict=False))
    top = Counter(g for i in train for g in grams(tokens[i], order))
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        occurrences = Counter(g for i in train for g in grams(tokens[i], n))
        different = Counter(g[1:] for g in levels[n + 1])
        levels[n] = {g: occurrences[g] if g[0] == 0 else c for g, c in different.items()}
    of = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    d = {n: (0, *ngram_lm.discounts(of(c))) for n, c in levels.items()}
    heads, mass = Counter(), Counter()
    for c in levels.values():
        for g, x in c.items():
            heads[g[:-1]] += x
            mass[g[:-1]] += d[len(g)][min(x, 3)]

    def probability(gram):
        if not gram:
            return 1 / (size + 1)
        below, head, x = probability(gram[1:]), gram[:-1], levels[len(gram)].get(gram, 0)
        return (max(x - d[len(gram)][min(x, 3)], 0) + mass[head] * below) / heads[head] if heads[head] else below

    assert len(got) == len(rows)
    for i, words in tokens.items():
        base = sum(math.log10((count[w] + 1) / (total + size + 1)) for w in words)
        score = sum(math.log10(probability(g)) for g in grams(words, order))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
        assert r.held_out == (i not in train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_ngram_blobs_round_trip():
    rng = np.random.default_rng(2)
    parts = [(rng.integers(0, 1 << 40, 50, dtype=np.uint64) >> np.uint64(rng.integers(0, 39)), rng.integers(0, 9, 50).astype(np.uint32), rng.integers(1, 1 << 33, 50)) for _ in range(20)]
    whole = ngram_lm._combined(parts)
    want = Counter()
    for c, w, n in parts:
        for key in zip(c.tolist(), w.tolist(), n.tolist(), strict=True):
            want[key[:2]] += key[2]
    assert list(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == sorted(want)
    for x, y in zip(ngram_lm._opened(ngram_lm._blob(whole)), whole, strict=True):
        assert x.tolist() == y.tolist()


def test_kneser_ney_probabilities_sum_to_one(docs, rows, spark, tmp_path):
    model = ngram_lm.train_model(docs.select("text"), f"file://{tmp_path}/lm")
    scorer = ngram_lm.Scorer(model)
    hashes = np.concatenate([np.load(f) for f in sorted((tmp_path / "lm").glob("words-*.hash.npy"))])
    for head in hashes[:5]:
        tokens = np.stack([np.full(len(hashes), head), hashes], axis=1).reshape(-1).astype(np.uint64)
        starts = np.arange(0, len(tokens) + 1, 2)
        both = scorer.score(tokens, starts)[1]
        first = scorer.score(np.full(1, head, np.uint64), np.array([0, 1]))[1][0]
        unknown = scorer.score(np.array([head, 12345], np.uint64), np.array([0, 2]))[1][0] - first
        assert (10 ** (both - first)).sum() + 10**unknown == pytest.approx(1.0, abs=1e-6)


def test_kneser_ney_without_text(empty, spark):
    assert ngram_lm.score_documents(empty, ngram_lm.training_fold()).count() == 0
    one = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    r = ngram_lm.score_documents(one, F.lit(False)).first()
    assert (r.train_tokens, r.n_tokens, r.score) == (0, 3, 0.0)


def test_kneser_ney_looks_up_repeated_ngrams_once(spark, tmp_path, monkeypatch):
    texts = [f"one two three four {w} two three five {w}" for w in ("six", "seven", "eight")] * 2
    model = ngram_lm.train_model(spark.createDataFrame([(t,) for t in texts], "text string"), f"file://{tmp_path}/lm")
    scorer, asked, plain = ngram_lm.Scorer(model), [], ngram_lm._within
    monkeypatch.setattr(ngram_lm, "_within", lambda values, low, high, wanted, most: asked.append(len(wanted)) or plain(values, low, high, wanted, most))
    some = ["two three unseen", *texts[:3]]
    once = list(ngram_lm.joined_tokens(pa.array(some)))
    one = scorer.score(*once[0])
    lookups = sum(asked)
    many = scorer.score(*next(ngram_lm.joined_tokens(pa.array(some * 50))))
    assert sum(asked) == 2 * lookups  # as many again, not fifty times as many
    assert all((np.tile(a, 50) == b).all() for a, b in zip(one, many, strict=True))
    monkeypatch.setattr(ngram_lm, "SCORE_TOKENS", 1)
    assert all((a == b).all() for a, b in zip(scorer.score(*next(ngram_lm.joined_tokens(pa.array(some)))), one, strict=True))


# --- 7: pieces


def test_streaming_viterbi(docs, rows, empty, monkeypatch):
    coder = viterbi_pieces.LaneViterbi(viterbi_pieces.default_pieces())
    p = coder.pieces

    def whole(text):
        s = viterbi_pieces.MARK + text.replace(" ", viterbi_pieces.MARK) if text else ""
        best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
        for i in range(len(s)):
            if best[i] + p.fallback > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + p.fallback, (i, None)
            node = p.trie
            for k in range(i, len(s)):
                node = node.get(s[k])
                if node is None:
                    break
                if "" in node and best[i] + node[""][0] > best[k + 1]:
                    best[k + 1], back[k + 1] = best[i] + node[""][0], (i, node[""][1])
        out, at = [], len(s)
        while at:
            i, piece = back[at]
            out += [p.byte_ids[b] for b in reversed(s[i:at].encode())] if piece is None else [piece]
            at = i
        return out[::-1]

    got = {r.doc_id: r for r in viterbi_pieces.encode_and_decode(docs).collect()}
    for i, t, *_ in rows:
        want = whole(t or "")
        assert coder.encode([t])[0].tolist() == want
        text = t or ""
        assert list(viterbi_pieces.stream_ids([text[:3], text[3:10], text[10:]], p)) == want
        r = got[i]
        assert (r.n_ids, r.round_trip, r.decoded_bytes) == (len(want), True, len(text.encode()))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert viterbi_pieces.encode_and_decode(empty).count() == 0
    unspaced = [(t or "").replace(" ", "") for _, t, *_ in rows] + ["nul\0 in it", "ab\u2581cd"]
    for block, lane in ((1 << 18, 512), (500, 40), (64, 8)):
        monkeypatch.setattr(viterbi_pieces, "BLOCK_CHARS", block)
        monkeypatch.setattr(viterbi_pieces, "LONGEST_LANE", lane)
        monkeypatch.setattr(viterbi_pieces, "LANE", lane // 4)
        ids, at = coder.encode([None, *unspaced, ""])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[], *map(whole, unspaced), []]


def test_lanes_commit_where_their_paths_meet(monkeypatch):
    coder = viterbi_pieces.LaneViterbi(viterbi_pieces.default_pieces())
    text = "the unbelievable internationalisation of countermeasures, without any regret " * 40
    want = list(viterbi_pieces.stream_ids([text], coder.pieces))
    for lane in (128, 1 << 14):
        monkeypatch.setattr(viterbi_pieces, "LANE", lane)
        coder.meetings = 0
        assert coder.encode([text])[0].tolist() == want
        # a commit in nearly every window of every lane, none of which begins where another lane does
        assert coder.meetings > 0.5 * len(text) / coder.pieces.longest * (lane - 2 * coder.pieces.longest) / lane


def test_matches_are_the_places_where_pieces_begin():
    coder = viterbi_pieces.LaneViterbi(viterbi_pieces.default_pieces())
    p, text = coder.pieces, "\u2581the\u2581unbelievable\u2581caf\u00e9\0\U0001f9ff\u2581\u2581abc"
    size = len(text) - 2  # pieces may end beyond the places asked for
    codes = coder.auto.code[[ord(c) for c in text]]
    found = coder.auto.matches(codes, size, p.longest)
    want = [[] for _ in range(p.longest + 1)]
    for at in range(size):
        node = p.trie
        for k, c in enumerate(text[at:], 1):
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                want[k].append((at, node[""][1]))
    assert [list(zip(places.tolist(), ids.tolist(), strict=True)) for places, ids in found] == want
    assert sum(map(len, want)) < size * p.longest / 3  # no row for every place and length


def test_viterbi_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c")], "doc_id long, text string")
    got = viterbi_pieces.encode_and_decode(df).collect()
    assert len(got) == 4 and len({r.ids_crc32 for r in got}) == 2


def test_streaming_viterbi_keeps_a_short_window():
    state = viterbi_pieces.StreamingViterbi(viterbi_pieces.Pieces(viterbi_pieces.default_pieces()))
    for _ in range(200):
        list(state.feed("some words here ".replace(" ", viterbi_pieces.MARK)))
        assert len(state.pending) < 200 and len(state.score) < 200


# --- 8: rANS


def test_rans_store(docs, rows, plain, empty):
    got = sorted(rans_store.encode_and_read(docs).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, t, *_) in zip(got, sorted(rows), strict=True):
        ids = [*plain(t), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert rans_store.encode_and_read(empty).count() == 0


@pytest.mark.parametrize(("n", "size"), [(1, 1), (5, 3), (5000, 300), (5000, 1), (40000, 49408)])
def test_rans_frames(n, size):
    ids = (np.random.default_rng(n).zipf(1.2, n) % size).astype("<u2")
    table = rans_store.Table.from_counts(np.bincount(ids, minlength=1 << 16))
    assert table.freq.sum() == 1 << 16
    data = rans_store.encode_frame(np.array([7]), np.array([n]), ids, table, lanes=64, checkpoint=1024)
    frame = rans_store.Frame.open(data, table)
    assert (frame.ids() == ids).all() and frame.doc_ids.tolist() == [7]
    last = len(frame.positions) - 1
    assert (frame.segment(last) == ids[last * 1024 :]).all()  # from a checkpoint, without what is before it
    broken = data[:-1] + bytes([data[-1] ^ 1])
    with pytest.raises(ValueError, match="damaged"):
        rans_store.Frame.open(broken, table)


def test_rans_table_of_many_rare_ids():
    counts = np.zeros(1 << 16, np.int64)
    counts[:49408] = 10**9 // np.arange(1, 49409)
    for c in (counts, np.maximum(counts, 1), np.where(np.arange(1 << 16) == 9, 10**12, 1)):
        table = rans_store.Table.from_counts(c)
        assert table.freq.sum() == 1 << 16 and (table.freq[c > 0] >= 1).all()
        ids = np.random.default_rng(3).permutation(np.append(np.flatnonzero(c), np.zeros(5000, np.int64))).astype("<u2")
        frame = rans_store.Frame.open(rans_store.encode_frame(np.array([1]), np.array([len(ids)]), ids, table, 64, 1024), table)
        assert (frame.ids() == ids).all()


def test_rans_ids_beyond_16_bits_raise():
    assert rans_store._unplaned(rans_store._planes(np.array([0, 65535], "<u4"))).tolist() == [0, 65535]
    with pytest.raises(ValueError, match="65536"):
        rans_store._planes(np.array([1, 65536], "<u4"))


# --- 9: shards


def test_vector_shards(docs, rows, empty):
    got = sharding.vector_shards(docs, 8).collect()
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        homes[t or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.vector_shards(empty, 8).count() == 0


def test_a_hot_group_is_split(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    got = sharding.vector_shards(df, 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    whole = sharding.vector_shards(df, 8, split_above=None).where("doc_id % 3 = 0").select("shard").distinct().count()
    assert whole == 1


def test_groups_within_a_shard_stay_whole(spark):
    """A tenth of all rows is one text: it stays together, repeated rows too, and bytes are near equal."""
    rng = random.Random(3)
    rows = [(i, "the same text again" if i % 10 == 0 else "word " * rng.randint(1, 8) + str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:200], "doc_id long, text string")
    got = sharding.vector_shards(df, 8).collect()
    assert len(got) == 3200
    assert len({r.shard for r in got if r.doc_id % 10 == 0}) == 1
    bytes_ = Counter()
    for r in got:
        bytes_[r.shard] += r.size
    assert max(bytes_.values()) < 1.02 * min(bytes_.values())


def test_shards_of_many_cells(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text")
    got = sharding.vector_shards(df, 3, cells=7, bins=4).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and len(got) == 5000
