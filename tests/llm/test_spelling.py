import random
import re
import zlib
from collections import Counter

import pytest

from boxrates.llm import spelling as S


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")


def brute_words(rows, least=7):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    result = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return result


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_words_are_counted_over_whole_texts(spark):
    rng = random.Random(3)
    runs = ["Straßenbahn", "straßenbahn", "ÉTUDIANTE", "étudiante", "internAtional", "sevenly", "short", "×÷×÷×÷×", "naïveté"]
    rows = [(i, " ,1".join(rng.choices(runs, k=40))) for i in range(60)]
    rows += [(None, "nothing nothing international"), (7, None), (8, ""), (9, "x" * 3_000_000 + " sevenly" * 5), (9, "sevenly")]
    found = {r.word: r.n for r in S.word_counts(docs(spark, rows)).collect()}
    assert found == brute_words(rows)


def test_a_task_hands_on_its_words_before_it_holds_too_many(spark, monkeypatch):
    texts = [(str(i), f"wordlike{chr(97 + i % 26)} another{chr(97 + i % 7)}") for i in range(300)]
    batch = spark.createDataFrame(texts, "id string, text string").toArrow().combine_chunks().to_batches()[0]

    def sums(parts):
        found = Counter()
        for part in parts:
            for word, n in zip(*[c.to_pylist() for c in part.columns], strict=True):
                found[word] += n
        return found

    whole = list(S._count(7, 31)(iter([batch, batch])))
    monkeypatch.setattr(S, "_HELD", 100)
    parts = list(S._count(7, 31)(iter([batch, batch])))
    assert len(whole) == 1 and len(parts) > 1 and sums(parts) == sums(whole)


@pytest.mark.parametrize("pairs", [1, 10**6])
def test_pairs_equal_brute_force_however_keys_are_refined(spark, pairs):
    rng = random.Random(pairs)
    words = {}
    for _ in range(25):
        word = "".join(rng.choices("abé", k=rng.randint(7, 10)))
        words[word] = rng.choice([2, 3, 30, 400])
        for _ in range(8):
            i = rng.randrange(len(word) + 1)
            kind = rng.randrange(3)
            near = word[:i] + (rng.choice("abé") if kind else "") + word[i + (kind != 1) :]
            if len(near) >= 7:
                words.setdefault(near, rng.choice([2, 3, 30, 400]))
    words |= {"z" * 300: 50, "z" * 301: 5, "z" * 150 + "y" + "z" * 150: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.variants(df, pairs=pairs)) == brute(words)


def test_a_shared_chunk_is_refined_and_loses_nothing(spark):
    words = {f"commonstart{a}{b}end": 2 + (a == b) * 28 for a in "abcdefghij" for b in "abcdefghij"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.variants(df, pairs=50)) == brute(words)


def test_chains_of_forms_end_at_the_root(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "aabbbbb": 200000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(S.variants(df))
    assert found == brute(words)
    assert {r[2] for r in found} == {"aabbbbb"}


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = {"wordiest": 2, "wordiesa": 20, "wordiesé": 20, "wordiesz": 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert dict((r[0], r[1]) for r in got(S.variants(df)))["wordiest"] == "wordiesa"


def test_empty_tables_and_tables_without_words(spark):
    assert S.variants(S.word_counts(docs(spark, []))).count() == 0
    assert S.variants(S.word_counts(docs(spark, [(1, "no long one"), (2, None)]))).count() == 0
