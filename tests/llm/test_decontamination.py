"""Operator 2 against a brute force that shares no code with it: edited copies of the given
benchmark items, in whole documents."""
import random
import re

import pytest

from sheaf.llm import decontaminate

BENCHMARK = "/root/testdata/sf0.1/benchmark.parquet"


def words(text):
    return re.findall(r"\w+", text.lower())


def grams(w, n):
    return {" ".join(w[k:k + n]) for k in range(len(w) - n + 1)}


def held(item, doc):
    """Share of the item's five-word shingles in the document, of question and answer apart
    where the item has both marks; fewer words are one shingle."""
    marked = re.fullmatch(r"\s*((?:question|q)\s*:.*?)\b((?:answer|a)\s*:.*)", item, re.I | re.S)
    shares = []
    for part in marked.groups() if marked else (item,):
        w = words(part)
        mine = grams(w, min(5, len(w)))
        shares.append(len(mine & grams(words(doc), min(5, len(w)))) / len(mine))
    return min(shares)


@pytest.mark.parametrize("lines", [False, True])
def test_edited_items_are_found_if_and_only_if_enough_is_left(spark, lines):
    rnd = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(BENCHMARK).orderBy("item_id").collect()]
    if lines:   # question and answer with marks, on lines of their own
        items = [(i, f"Question: {t}\nAnswer: " + " ".join(f"a{i}x{k}" for k in range(3 + i % 9))) for i, t in items]
    docs, exp = [], set()
    noise = [f"n{k}" for k in range(300)]
    for i, text in items:
        for _ in range(6):
            words = re.split(r"( |\n)", text)
            for _ in range(rnd.choice([1, 1, 1, 2, 5, 9])):
                k = rnd.randrange(0, len(words), 2)
                words[k] = rnd.choice(["zz", "", "yy zz"])
            doc = " ".join(rnd.choices(noise, k=rnd.randint(0, 60))) + " " + "".join(words) + " " + " ".join(rnd.choices(noise, k=rnd.randint(0, 60)))
            docs.append((len(docs), doc))
            if held(text, doc) >= 0.8:
                exp.add((docs[-1][0], i))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert exp <= got
    texts = dict(items)
    assert all(held(texts[i], docs[d][1]) >= 0.8 for d, i in got)
    assert len(exp) > 400


def test_every_one_word_substitution_that_leaves_enough(spark):
    """The items of the given benchmark that have line breaks but no marks: whole items decide."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(BENCHMARK).collect()]
    docs, owner = [], {}
    for i, text in items:
        tokens = re.split(r"(\W+)", text)
        for k in range(0, len(tokens), 2):
            if tokens[k]:
                doc = "".join([*tokens[:k], "zzz", *tokens[k + 1:]])
                if held(text, doc) >= 0.8:
                    owner[len(docs)] = i
                    docs.append((len(docs), doc))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    lost = set(owner.items()) - {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(docs) > 5000 and not lost
