import random

import numpy as np
import pytest

from molspark.llm import contamination
from tests.llm.helpers import SCHEMA, prose, rows, table

ITEM = "item_id long, text string, words int"


def align_by_cells(query, window):
    best = 0
    above = [0] * (len(window) + 1)
    for q in query:
        row = [0]
        for j, w in enumerate(window):
            row.append(max(0, above[j] + (contamination.MATCH if q == w else contamination.MISMATCH), above[j + 1] + contamination.GAP, row[j] + contamination.GAP))
        best, above = max(best, max(row)), row
    return best


def test_alignment_equals_the_cell_by_cell_table():
    rnd = np.random.default_rng(3)
    queries = [rnd.integers(1, 6, rnd.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    windows = [rnd.integers(1, 6, rnd.integers(1, 50)).astype(np.uint64) for _ in range(60)]
    scores, ends = contamination.align(queries, windows)
    assert scores.tolist() == [align_by_cells(q, w) for q, w in zip(queries, windows)]
    for q, w, s, e in zip(queries, windows, scores, ends):
        assert align_by_cells(q, w[:e]) == s


def edited(rnd, words, rate):
    out = []
    for w in words:
        kind = rnd.random()
        if kind < rate * 0.6:
            out.append("edited")
        elif kind < rate * 0.8:
            continue
        else:
            out += [w, "put"] if kind < rate else [w]
    return out


def corpus(spark):
    """Items, documents with copies of them, and the pairs to find."""
    rnd = random.Random(9)
    made = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    items = [(i, made(rnd.randrange(12, 60)), 1) for i in range(20)] + [(100, made(700), 1), (200, "too short", 1), (201, None, 1), (202, "", 1), (None, made(40), 1)]
    items.append(items[0])
    docs, wanted = [], set()
    for i, (item, text, _) in enumerate(items[:21]):
        for k, rate in enumerate((0.0, 0.15)):
            copy = " ".join(edited(rnd, text.split(), rate))
            copy = copy.upper().replace(" ", ", ") if k else copy
            docs.append((10 * i + k, f"{made(rnd.randrange(0, 200))} {copy} {made(rnd.randrange(0, 200))}", "en", "a", 1))
            wanted.add((10 * i + k, item))
    docs.append((5000, made(30_000) + " " + items[3][1] + " " + made(10), "en", "a", 1))
    wanted.add((5000, 3))
    docs += [(6000 + i, made(300), "en", "a", 1) for i in range(30)] + [r for r in rows(n=10) if r[0] is None or r[0] >= 1000]
    half = items[2][1].split()
    docs.append((7000, made(50) + " " + " ".join(half[: len(half) // 4]) + " " + made(50), "en", "a", 1))  # a quarter is no copy
    return table(spark, docs), spark.createDataFrame(items, ITEM), wanted, docs


def test_copies_are_found_and_others_left(spark):
    docs, items, wanted, _ = corpus(spark)
    found = contamination.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and len(found) == len(wanted)
    exact = {(r.doc_id, r.item_id): r for r in found}
    assert all(r.score == 1.0 for (d, _), r in exact.items() if d % 10 == 0 and d < 200)


def test_blocks_do_not_change_the_result(spark):
    docs, items, wanted, _ = corpus(spark)
    found = contamination.contaminated(docs, items, block_words=200).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted


def test_frequent_passage_is_found_everywhere(spark):
    rnd = random.Random(1)
    item = prose(rnd, 60)
    docs = [(i, prose(rnd, 20) + " " + item + " " + prose(rnd, 20), "en", "a", 1) for i in range(300)]
    found = contamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item, 1)], ITEM))
    assert found.count() == 300


@pytest.mark.parametrize("n", [9, 300])
@pytest.mark.parametrize("whole", [0, 1, 40])
def test_frequent_edited_and_partial_copies_are_found(spark, n, whole):
    """The same edited or partial copy in many documents (of 3 n), beside none, one or some of the whole item."""
    rnd = random.Random(4)
    items = [prose(rnd, 38), prose(rnd, 59)]
    words = items[0].split()
    copies = [" ".join("edited" if k in (4, 12, 19, 27, 34) else w for k, w in enumerate(words)), " ".join(items[1].split()[:40])]
    docs = [(i, f"{prose(rnd, 20)} {copies[0] if i < n else copies[1] if i < 2 * n else ''} {prose(rnd, 20)}", "en", "a", 1) for i in range(3 * n)]
    docs += [(9000 + i, f"{prose(rnd, 20)} {' '.join(items)}", "en", "a", 1) for i in range(whole)]
    wanted = {(i, int(i >= n)) for i in range(2 * n)} | {(9000 + i, k) for i in range(whole) for k in (0, 1)}
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], ITEM)
    assert {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, items).collect()} == wanted
    assert contamination.without_contaminated(docs, items).count() == n


def test_long_excerpt_of_a_long_item_is_found(spark):
    rnd = random.Random(8)
    words = [f"{prose(rnd, 1)}{k}" for k in range(700)]
    cuts = {0: (0, 120), 1: (300, 360), 2: (580, 700), 3: (90, 200), 4: (200, 240)}  # the last one is too short
    docs = [(i, f"{prose(rnd, 50)} {' '.join(words[a:b])} {prose(rnd, 50)}", "en", "a", 1) for i, (a, b) in cuts.items()]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(words), 1)], ITEM)
    found = {r.doc_id: r.end_word - r.start_word for r in contamination.contaminated(docs, items).collect()}
    assert found == {i: b - a for i, (a, b) in cuts.items() if i < 4}


def test_spans_in_parts(monkeypatch):
    rnd = np.random.default_rng(1)
    block = contamination.Block(list(range(9)), [rnd.integers(1, 4, 30).astype(np.uint64) for _ in range(9)])
    words = rnd.integers(1, 4, 500).astype(np.uint64)
    wanted = block.spans(words)
    monkeypatch.setattr(contamination, "_HITS", 7)
    assert len(wanted) and (block.spans(words) == wanted).all()


def test_scripts_without_blanks_and_short_items(spark):
    chinese = "今天的天气非常好，我们一起去公园散步吧。路上遇见了一位老朋友，他请我们喝了一杯很香的绿茶。"
    thai = "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะกัน"
    items = [(1, chinese, 1), (2, thai, 1), (3, "blue horses fly", 1), (4, "seven small words stand in this row", 1), (5, "two words", 1)]
    edited = chinese.replace("公园", "河边").replace("，", "")
    docs = [
        (1, "他说：" + chinese + "然后走了。", "zh", "a", 1), (2, "开头" + edited + "结尾", "zh", "a", 1), (3, "完全不同的一段文字，讲的是别的事情。" * 3, "zh", "a", 1),
        (4, thai, "th", "a", 1), (5, "I saw Blue horses, fly away", "en", "a", 1), (6, "blue horses never fly", "en", "a", 1),
        (7, "here seven small words stand in this row too", "en", "a", 1), (8, "seven small words stand in that row, two words", "en", "a", 1),
    ]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)
    found = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (4, 2), (5, 3), (7, 4)}
    assert {r.doc_id for r in contamination.without_contaminated(docs, items, block_words=20).collect()} == {3, 6, 8}


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items, wanted, data = corpus(spark)
    kept = contamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {d for d, _ in wanted}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d[0] for d in data if d[0] not in bad), key=repr)


def test_empty(spark):
    docs, items, *_ = corpus(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert contamination.contaminated(none, items).collect() == []
    assert contamination.contaminated(docs, items.limit(0)).collect() == []
    assert contamination.without_contaminated(docs, items.limit(0)).count() == docs.count()
