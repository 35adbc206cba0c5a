"""Token alignment against pairwise overlaps of byte ranges."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from memlattice.llm import alignment as A

MORE = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "▁", "  two  spaces ", "tab\there\r\nnew", "ﬁ ligature ①", "naïve café", "🦤🦤 dodo", "\x00nul\x00", "x" * 30, "'s 're", "​", "the the the the"]


def plain(tools, text):
    """(A ids with ranges, B ids with ranges), or two empty lists."""
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    ids_a = tools.a.encode(" " + text, add_special_tokens=False).ids
    ids_b = tools.b.encode(text)
    code = A.byte_alphabet()
    spell_a = [bytes(code[c] for c in tools.a.id_to_token(i)) for i in ids_a]
    spell_b = [bytes([int(tools.b.id_to_piece(i)[1:-1], 16)]) if tools.b.is_byte(i) else tools.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
        return [], []
    for ids, spelled in ((ids_a, spell_a), (ids_b, spell_b)):
        at, rows = 0, []
        for i, s in zip(ids, spelled, strict=True):
            rows.append((i, at, at + len(s)))
            at += len(s)
        out.append(rows)
    return out


def expected(tools, texts):
    links, groups, sizes = [], [], []
    for t in texts:
        a, b = plain(tools, t)
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 800 else None)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        lo, parts = 0, []
        for hi in cuts:
            parts.append(tuple(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        groups.append(";".join("|".join(p) for p in parts))
        sizes.append((len(a), len(b), len(cuts)))
        if links[-1] is None:  # long: sweep
            links[-1], j = [], 0
            for i, s, e in a:
                while b[j][2] <= s:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < e:
                    links[-1].append((i, b[k][0]))
                    k += 1
    return links, groups, sizes


@pytest.fixture(scope="module")
def tools():
    return A.Aligner(*A.default_files())


def test_alignment(spark, docs, rows, tools):
    texts = [r[1] for r in rows] + MORE
    more = spark.createDataFrame([(len(rows) + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    table = docs.select("doc_id", "text", "_n", "rank").unionByName(more, allowMissingColumns=True)
    links, groups, sizes = expected(tools, texts)
    count = Counter(p for ls in links for p in set(ls))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    got = {r.doc_id: r for r in A.align_documents(table).collect()}
    assert len(got) == len(texts)
    assert sum(bool(g) for g in groups) > len(texts) // 2 and not groups[texts.index("a▁b")]
    for i, ls in enumerate(links):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups) == sizes[i], texts[i]
        assert (r.n_links, r.n_best, r.count_sum) == (len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls))
        assert r.groups_sha256 == (hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else "")


def test_blocks_do_not_matter(docs):
    want = sorted(A.align_documents(docs).collect())
    assert sorted(A.align_documents(docs.repartition(1), block_bytes=100).collect()) == want


def test_small_blocks_and_many_rows(tools):
    texts = ["one two", None, "", "a▁b", "one two three"]
    x = tools.align(texts)
    assert x.at_a.tolist()[1] == x.at_a.tolist()[4] and x.at_groups[4] == x.at_groups[1]
    for i in (0, 4):
        y = tools.align([texts[i]])
        assert x.group_a[x.at_groups[i] : x.at_groups[i + 1]].tolist() == y.group_a.tolist()
        assert tools.group_digests(x)[i] == tools.group_digests(y)[0]


def test_token_groups(spark, tools):
    got = A.token_groups(spark.createDataFrame([(1, "hello worlds"), (2, None)], "doc_id long, text string")).collect()
    a, b = plain(tools, "hello worlds")
    assert got[0].ids_a == [x[0] for x in a] and got[0].ids_b == [x[0] for x in b]
    assert sum(got[0].group_a) == len(a) and sum(got[0].group_b) == len(b) and got[1].ids_a == []


def test_empty_null_ids_and_repeats(spark, empty):
    assert A.align_documents(empty).count() == 0
    df = spark.createDataFrame([(None, "some text"), (7, "some text"), (7, "some text"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.n_best, r.count_sum) for r in A.align_documents(df).collect())
    n = got[0][1]
    assert n > 0 and got == [(0, n, n, 3 * n), (7, n, n, 3 * n), (7, n, n, 3 * n), (8, 0, 0, 0)]


def test_runs_and_forgetting(tools):
    """Cached runs give the ids of whole texts, also where the worker's table starts anew."""
    texts = ["a b", "a  b c", "naïve élan  x", "x\n y z", " lead and trail  ", "12 's don't", "e ́ combining", "ÿ ß", None, "a b"]
    small = A.Aligner(*A.default_files(), cache_runs=3)
    for _ in range(2):
        x = small.align(texts)
        for i, t in enumerate(texts):
            a, b = plain(tools, t)
            assert x.ids_a[x.at_a[i] : x.at_a[i + 1]].tolist() == [r[0] for r in a], t
            assert x.ids_b[x.at_b[i] : x.at_b[i + 1]].tolist() == [r[0] for r in b], t


@pytest.fixture
def worker(monkeypatch):
    """The function that tasks run over batches of documents, without Spark."""

    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    class Docs:
        sparkSession = None
        mapInArrow = lambda self, work, schema: work

    for name, value in (("TaskContext", Task), ("ship", lambda spark: None), ("narrow", lambda docs: docs)):
        monkeypatch.setattr(A, name, value)
    work = A.aligned_blocks(Docs())
    return lambda texts: [r.to_pydict() for r in work(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])]))]


@pytest.mark.parametrize("n_texts", [400, 1])
def test_memory_of_a_block(worker, n_texts):
    """a worker held some 60 bytes for each byte of a block; two such workers beside a full heap are more than an executor has."""
    words = " ".join(f"word{i % 977} and the rest of {i % 61}" for i in range(4_000_000 // n_texts // 28))
    worker([words[:1000]])
    tracemalloc.start()
    got = worker([words] * n_texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and len(got[0]["doc_id"][0]) == n_texts and min(got[0]["n_a"][0]) > 0
    assert sum(len(words) for _ in range(n_texts)) > 3_500_000 and peak < 120e6


def test_pieces_do_not_matter(worker, tools, monkeypatch, rows):
    long = [" ".join(r[1] for r in rows if r[1])[:6000], "no_space" * 90 + " then some words " * 40, "ÿ naïve ß élan " * 70, "же нет " * 120, "fine words " * 60 + "a▁b " + "and more " * 60, "two  spaces \n " * 60, "x" * 800]
    texts = ["a b", None, *long, "", "a▁b", "the the", *MORE, *long[::-1]]
    monkeypatch.setattr(A, "PIECE_BYTES", 1 << 30, raising=False)
    want = worker(texts)
    assert want[0]["n_a"][0][6] == 0 and want[0]["n_a"][0][2] > 1000
    for size in (7, 100, 333):
        monkeypatch.setattr(A, "PIECE_BYTES", size)
        assert worker(texts) == want
        parts = list(tools.cut((" " + long[0]).encode()))
        assert b"".join(parts).decode() == " " + long[0] and len(parts) > 6000 / max(size, 100) and (size < 100 or max(map(len, parts)) <= size)


def test_row_groups_of_blocks(docs, monkeypatch):
    """the writer looked at its memory after 100 blocks only, and readers held all blocks of a file at once."""
    tables, real = {}, A.written
    monkeypatch.setattr(A, "GROUP_BYTES", 1 << 15, raising=False)
    monkeypatch.setattr(A, "written", lambda df, name, **options: tables.setdefault(name, real(df, name, **options)))
    A.align_documents(docs.repartition(1), block_bytes=2000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables["aligned"].inputFiles()]
    assert max(f.num_rows for f in files) > 10 and all(f.num_row_groups > 2 for f in files if f.num_rows > 10)
