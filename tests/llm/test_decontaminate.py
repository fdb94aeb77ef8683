import random
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm.decontaminate import PERCENT, Q, Index, align, align_all, budget, mark_leaks, normalised


def edits_in(item, text):
    """Fewest edits between the item and any passage of text, all cells of the table filled."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return normalised(text)[0].tolist()


def test_normalised():
    codes, at = normalised("  Ab-- c\nİÉ1! ")
    assert "".join(map(chr, codes)) == "ab c İé1" and at.tolist() == [2, 3, 4, 7, 8, 9, 10, 11]
    assert [len(x) for x in normalised(None)] == [0, 0] == [len(x) for x in normalised("?!")]


@pytest.mark.parametrize("seed", range(6))
def test_same_as_brute_force(seed):
    """Items found exactly where the full table has few enough edits, for edited copies around the budget."""
    rng = random.Random(seed)
    words = ["the", "and", "of", "thonre", "inwh", "erst", "ound", "tion", "enti", "ha", "on", "ré"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 40)))) for i in range(12)]
    texts = []
    for _ in range(25):
        body = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.8:
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + budget(len(copy)) + 3)):
                p = rng.randrange(len(copy))
                kind = rng.randrange(3)
                if kind == 0:
                    copy[p] = rng.choice("abcxyz ")
                elif kind == 1:
                    copy.insert(p, rng.choice("abcxyz "))
                elif len(copy) > 1:
                    del copy[p]
            body.insert(rng.randint(0, len(body)), "".join(copy))
        texts.append(rng.choice(["", "- "]) + " ".join(body).replace("the and", "The, AND"))
    found = Index(items).search(texts)
    for text, leaks in zip(texts, found, strict=True):
        codes = plain(text)
        for item_id, item in items:
            own = [x for x in leaks if x[0] == item_id]
            least = edits_in(plain(item), codes) if codes else 99
            m = len(plain(item))
            assert bool(own) == (least <= budget(m, Q, PERCENT)), (item, text, least)
            for _, start, end, edits in own:
                assert edits_in(plain(item), plain(text[start:end])) == edits
            if own:
                assert min(x[3] for x in own) == least


def test_items_that_repeat_themselves():
    """Short copies side by side are each found in their own text, and in pieces of a long one."""
    item = "ha " * 34
    index = Index([(1, item)])
    found = index.search([item] * 9 + ["no copy in this one"] + [item] * 2)
    assert [bool(x) for x in found] == [True] * 9 + [False] + [True] * 2
    long = "ha " * 5000
    leaks = index.search([long])[0]
    assert min(x[1] for x in leaks) < 300 and max(x[2] for x in leaks) > len(long) - 300 and all(x[3] == 0 for x in leaks)


def test_copies_apart_in_one_text_are_all_found():
    item = "la " * 34
    text = f"{item} and then some other words {item} more of them here {item} the end"
    leaks = Index([(1, item)]).search([text])[0]
    for start in (0, text.index(" and") - 1 + len(" and then some other words "), text.rindex("la la", 0, text.index(" the end"))):
        assert any(x[1] <= start + 3 and x[2] >= start - 3 and x[3] == 0 for x in leaks)
    covered = {i for _, a, b, _ in leaks for i in range(a, b)}
    assert all(any(text.index(part) + k in covered for k in range(len(item))) for part in (f"{item} and", f"{item} more", f"{item} the"))


@pytest.mark.parametrize("seed", range(4))
def test_a_text_does_not_depend_on_its_neighbours(seed):
    rng = random.Random(seed)
    item, beat = "".join(rng.choice("abcdefgh ij") for _ in range(200)), "ha " * 40
    index = Index([(1, item), (2, beat), (3, "short")])
    cut = item[:80] + item[93:]
    texts = [rng.choice(["", None, "x", "ha", beat, beat[: rng.randrange(90)], item, cut, f"short {cut}", "?", "some other words of no item"]) for _ in range(150)]
    assert index.search(texts) == [index.search([t])[0] for t in texts]
    assert all(found for t, found in zip(texts, index.search(texts), strict=True) if t == cut) and cut in texts


def test_same_leaks_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.selectExpr("-doc_id", "substr(text, 1, 1)"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = None
    for n in (1, 7, 50):
        found = sorted((r["doc_id"], str(r["leaks"])) for r in mark_leaks(docs.repartition(n), bench).collect())
        first = first or found
        assert found == first


def test_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "noise words everywhere here " * 5000 + item.upper() + " tail" * 5000
    rows = [(1, f"start {item} end", "x"), (1, f"start {item} end", "x"), (2, None, None), (3, "", "x"), (4, "clean text", "x"), (5, long, "x"), (6, item.replace("delta", "dolta"), "x"), (7, "so a yes!", "x"), (8, f"{item} {item}", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "!?"), (14, "Yes"), (10, item)], "item_id long, text string")
    out = [(r["doc_id"], [tuple(x) for x in r["leaks"]]) for r in mark_leaks(docs, bench).collect()]
    whole = (10, 6, 6 + len(item), 0)
    assert out[:5] == [(1, [whole]), (1, [whole]), (2, []), (3, []), (4, [])]
    assert out[5][1] == [(10, long.index("ALPHA"), long.index("ALPHA") + len(item), 0)]
    assert out[6][1] == [(10, 0, len(item), 1)] and out[7][1] == [(14, 5, 8, 0)]
    assert [x[:2] for x in out[8][1]] == [(10, 0), (10, len(item) + 1)]
    assert mark_leaks(docs.limit(0), bench).count() == 0
    assert mark_leaks(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_documents(spark):
    """All documents that hold an item unchanged are found, and no others here."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    out = mark_leaks(docs, bench).collect()
    assert [any(t in (r["text"] or "") for t in items) for r in out] == [bool(r["leaks"]) for r in out]
    assert np.mean([bool(r["leaks"]) for r in out]) > 0


def test_memory_of_a_long_item():
    """Aligning an item of 20,000 characters holds rows of its band, not a table."""
    r = np.random.default_rng(1)
    item = r.integers(97, 123, 20_000).astype(np.uint32)
    text = np.concatenate([item[:9_000], item[9_100:], item[:50]])
    tracemalloc.start()
    edits, start, end = align(item, text, -300, 300, 2_400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (edits, start, end) == (100, 0, 19_900) and most < 20 << 20


def test_bands_are_aligned_together():
    """Bands of different widths and items, many at once, give what each gives by itself, and what the full table says where the band is wide enough."""
    rng = random.Random(5)
    bands = []
    for _ in range(300):
        item = [ord(rng.choice("abc ")) for _ in range(rng.randint(1, 60))]
        cut = rng.randint(0, len(item))
        text = [ord(rng.choice("abc ")) for _ in range(rng.randint(0, 20))] + item[:cut] + item[cut + rng.randint(0, 4) :]
        whole = rng.random() < 0.5
        lo, hi = (-len(item), len(text) + 1) if whole else (lo := rng.randint(-20, 20), lo + rng.randint(4, 40))
        bands.append((np.array(item, np.uint32), np.array(text, np.uint32), lo, hi, rng.choice((0, 3, 60))))
    together = align_all(bands)
    assert together == [align(*b) for b in bands] and None in together
    for (item, text, lo, hi, most), got in zip(bands, together, strict=True):
        if (lo, hi) == (-len(item), len(text) + 1):
            least = edits_in(item.tolist(), text.tolist())
            assert (got[0] if got else None) == (least if least <= most else None)


def test_cells_that_hold_enough_are_kept():
    rng = np.random.default_rng(2)
    cells, need = rng.integers(-50, 5_000, 20_000), np.full(20_000, 12)
    kept = Index._crowded(cells, need)
    held = dict(zip(*np.unique(cells, return_counts=True), strict=True))
    assert all(k or held[c] + max(held.get(c - 1, 0), held.get(c + 1, 0)) < 12 for c, k in zip(cells.tolist(), kept.tolist(), strict=True)) and not kept.all()
