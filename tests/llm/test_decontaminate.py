import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lectern.llm import decontaminate

from .conftest import SCHEMA, prose

ITEM = "item_id bigint, text string, extra string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def weighted(ws):
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def like(a, b):
    a, b = weighted(a), weighted(b)
    weight = lambda s: sum(len(w.encode()) for w in s)
    both, either = sum(weight(s) * n for s, n in (a & b).items()), sum(weight(s) * n for s, n in (a | b).items())
    return both / either if either else 0.0


def brute(text, items):
    """Items that some window of the text, as long as the item, equals in 0.8 of its weighted shingles; all windows are tried."""
    ws, out = words(text), set()
    for item_id, item in items:
        iw = words(item)
        if iw and any(like(ws[i : i + len(iw)], iw) >= 0.8 for i in range(len(ws))):
            out.add(item_id)
    return out


def test_whole_items_and_edits_at_the_end_are_found(spark, odd_docs):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([15, 17, 23, 31, 44, 59, 120])] + [(90, ""), (91, None), (92, "!!!"), (93, "two words"), (94, prose(500, 15))]
    rows = []
    for i, (_, text) in enumerate(items[:7]):
        rows.append((i, prose(i, 40) + " " + text.upper().replace(" ", ", ") + ". " + prose(50 + i, 40), None, None, None))
        rows.append((100 + i, text, None, None, None))
        rows.append((200 + i, prose(i, 30) + " " + text.rsplit(" ", 1)[0] + " zzz " + prose(50 + i, 40), None, None, None))
        rows.append((300 + i, prose(i, 30) + " " + " ".join(text.split()[: len(text.split()) // 2]) + " " + prose(70 + i, 40), None, None, None))
    rows += [(400, "such Two-words here", None, None, None), (401, None, None, None, None), (402, "", None, None, None), (403, prose(999, 5000), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "leaks_0").repartition(3)
    out = decontaminate.find_leaks(docs, spark.createDataFrame([(*x, "e") for x in items], ITEM))
    assert out.columns == [*docs.columns, "leaks"]
    for r in out.collect():
        assert {x.item_id for x in r.leaks} == brute(r.text, items), r.doc_id
        assert all(0.8 <= x.similarity <= 1 for x in r.leaks)
    assert all(r.leaks == [] for r in decontaminate.find_leaks(odd_docs, spark.createDataFrame([], ITEM)).collect())


def test_chunks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(500 + i, 30), "") for i in range(12)], ITEM)
    docs = spark.createDataFrame([(i, prose(i, 50) + " " + prose(500 + i % 12, 30), None, None, None) for i in range(30)], SCHEMA)
    leaks = lambda: {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontaminate.find_leaks(docs, items).collect()}
    whole = leaks()
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 500)
    assert leaks() == whole == {i: [i % 12] for i in range(30)}
    # One pass a task: the index of one chunk at a time.
    plan = decontaminate.find_leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_fingerprints_alone_find_edited_items():
    """Recall of the SimHash windows without the rare shingles, by kind of edit; 0.95 at least, all with them."""
    r = random.Random(3)
    items = [(i, prose(8000 + i, n, 3000)) for i, n in enumerate([15, 18, 20, 25, 30, 38, 44, 50, 55, 60, 90])]
    edits = {
        "front": lambda ws, m: ["zzz"] * m + ws[m:],
        "back": lambda ws, m: ws[:-m] + ["zzz"] * m,
        "both": lambda ws, m: ["zzz"] + ws[1:-1] + ["zzz"],
        "inner": lambda ws, m: [*ws[: (k := r.randrange(2, len(ws) - 2))], "zzz", *ws[k + 1 :]],
        "inserted": lambda ws, m: [*ws[: (k := r.randrange(1, len(ws)))], "zzz", *ws[k:]],
        "dropped": lambda ws, m: [*ws[: (k := r.randrange(0, len(ws)))], *ws[k + 1 :]],
    }
    whole, bare = (decontaminate.Benchmark(*map(list, zip(*items))) for _ in range(2))
    bare.rare = decontaminate.Rare(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    for kind, edit in edits.items():
        cases = [(i, f"{prose(r.randrange(10**6), 20, 3000)} {' '.join(edit(t.split(), r.randrange(1, max(2, len(t.split()) // 9))))} {prose(r.randrange(10**6), 9, 3000)}") for i, t in items for _ in range(8)]
        cases = [(i, text) for i, text in cases if i in brute(text, [(i, dict(items)[i])])]
        texts = pa.array([text for _, text in cases])
        found = [[i in {x["item_id"] for x in leaks} for (i, _), leaks in zip(cases, b.leaks(texts))] for b in (whole, bare)]
        assert len(cases) > 15 and all(found[0]) and sum(found[1]) >= 0.95 * len(cases), kind


def test_empty_tables(spark, no_docs):
    assert decontaminate.find_leaks(no_docs, spark.createDataFrame([(1, "a b c", "")], ITEM)).count() == 0


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = prints[r.integers(0, 300, 2000)].copy()
    for k in range(len(near)):
        for bit in r.choice(64, r.integers(0, 9), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*(x.tolist() for x in decontaminate.Index(prints).within(near))))
    distance = np.bitwise_count(near[:, None] ^ prints[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS))))


def test_running_votes_wrap_without_harm():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 2**63, 70_000, dtype=np.uint64)
    hashes[:] |= np.uint64(1)
    for length in (40, 255, 300):
        got = decontaminate.fingerprints(decontaminate.running_votes(hashes, length), length)
        for at in (0, 40_000, 69_000):
            bits = np.unpackbits(hashes[at : at + length].view(np.uint8)).reshape(-1, 64).sum(axis=0) > length // 2
            assert got[at] == np.packbits(bits).view(np.uint64)[0]


def test_query_finds_every_whole_item(spark):
    from lectern.llm.registry import QUERIES

    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    whole = lambda text: {i for i, t in items if f" {' '.join(words(t))} " in f" {' '.join(words(text))} "}
    rows = QUERIES["op4_decontamination"](spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = {int(x) for x in r.item_ids.split(",") if x}
        assert whole(docs[r.doc_id]) <= found and all(brute(docs[r.doc_id], [(i, dict(items)[i])]) for i in found)


def test_edits_at_every_place_are_found():
    """Words dropped, replaced, added and moved anywhere, in items of every length: as all windows by brute force."""
    r, rows = random.Random(7), []
    items = [(i, prose(800 + i, n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 15, 15, 20, 20, 22, 25, 30, 60])]
    items += [(50, "so so so so so so so so on and on and on and on and so on"), (51, " ".join(["la"] * 20)), (52, prose(801, 4) + " " + prose(812, 25))]
    for _, item in items:
        ws = item.split()
        for at in range(len(ws)):
            edited = r.choice([ws[:at] + ws[at + 1 :], ws[:at] + ["zzz"] + ws[at + 1 :], ws[:at] + ["zzz"] + ws[at:], ws[at:] + ws[:at]])
            before, after = (prose(r.randrange(10**6), r.choice([0, 3, 12])) for _ in range(2))
            rows.append(" ".join([before, *edited, after]))
    rows += [None, "", "la", " ".join(["la"] * 500), "so on " * 40]
    want = [brute(text, items) for text in rows]
    found = decontaminate.Benchmark(*zip(*items)).leaks(pa.array(rows, pa.string()))
    assert [{x["item_id"] for x in leaks} for leaks in found] == want
    for text, leaks in zip(rows, found):
        ws = words(text)
        for x in leaks:
            iw = words(dict(items)[x["item_id"]])
            every = [like(ws[i : i + len(iw)], iw) for i in range(len(ws))]
            assert (x["word"], x["similarity"]) == (every.index(max(every)), max(every))


def edited_items():
    r = random.Random(11)
    items = [(i, prose(6000 + i, n, 3000)) for i, n in enumerate([15, 17, 20, 24, 29, 35, 42, 50, 59, 80, 120])]
    rows = []
    for i, t in items:
        for at in range(0, len(t.split()), 3):
            ws = t.split()
            ws = r.choice([ws, ws[:at] + ["zzz"] + ws[at + 1 :], ws[:at] + ws[at + 1 :], ["zzz"] + ws[1:]])
            rows.append((i, f"{prose(r.randrange(10**6), 15, 3000)} {' '.join(ws)} {prose(r.randrange(10**6), 5, 3000)}"))
    return items, rows


def test_fingerprints_decide_where_to_look(spark, monkeypatch):
    """Without `exact`, what the Hamming index finds is all that is compared: without the index nothing is found."""
    items, rows = edited_items()
    docs = spark.createDataFrame([(k, text, None, None, None) for k, (_, text) in enumerate(rows)], SCHEMA)
    bench = spark.createDataFrame([(i, t, "") for i, t in items], ITEM)
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.find_leaks(docs, bench, exact=False).collect()}
    want = {k: brute(text, items) for k, (_, text) in enumerate(rows)}
    assert all(found[k] <= want[k] for k in want) and sum(map(len, want.values())) > 100
    assert sum(map(len, found.values())) >= 0.99 * sum(map(len, want.values()))
    bare = decontaminate.Benchmark(*map(list, zip(*items)), exact=False)
    monkeypatch.setattr(decontaminate.Index, "within", lambda self, prints: (np.zeros(0, np.int64),) * 2)
    assert not any(bare.leaks(pa.array([text for _, text in rows])))


def test_windows_are_of_the_items_size():
    for n in range(1, 400):
        runs = decontaminate.runs_of(n)
        assert max(length for length, _ in runs) > n / 1.3 - 1 and all(0 <= at <= n - length for length, at in runs)
        assert {at for length, at in runs if length == max(x for x, _ in runs)} >= {0, n - max(x for x, _ in runs)}


def test_repeated_items_count_once(spark, monkeypatch):
    """A repeated item is in one chunk once, and chunks are bounded by bytes."""
    one = prose(500, 30)
    items = spark.createDataFrame([(1, one, str(k)) for k in range(300)] + [(2 + k, prose(600 + k, 30), "") for k in range(40)], ITEM)
    docs = spark.createDataFrame([(1, prose(1, 20) + " " + one, None, None, None), (2, prose(2, 50), None, None, None)], SCHEMA)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 1000)
    known, chunks = decontaminate.in_chunks(items.select("item_id", "text"))
    sizes = {}
    for r in known.collect():
        sizes.setdefault(r.chunk, []).append(len(r.text))
    assert sum(map(len, sizes.values())) == 41 and max(sizes) < chunks and all(sum(x) - x[-1] <= 2000 for x in sizes.values())
    for exact in (True, False):
        got = decontaminate.find_leaks(docs, items.where("item_id < 12"), exact=exact).collect()
        assert {r.doc_id: [x.item_id for x in r.leaks] for r in got} == {1: [1], 2: []}
