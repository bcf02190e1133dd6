"""Cleaning of pages against a plain loop over lines, its cases, and its cost."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from studylake.functions import pages as P

_STEM = re.compile("[" + P.STEM_ENDS + "]$|" + "|".join(P.STEM_WORDS))


def plain(pages):
    """The same by one loop that moves lines in a list."""
    split = lambda p: re.split("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", p or "")
    bare = lambda x: x.strip("".join(map(chr, range(33))))
    seen = Counter(bare(x) for p in pages for x in split(p))
    done = []
    for page in pages:
        out = []
        for x in split(page):
            t = bare(x)
            if t and (seen[t] >= 3 or re.search(r"第\s*\d+\s*页\s*[,，]?\s*共\s*\d+\s*页", t)):
                continue
            behind = re.match(r"(.+[：:？?）)]\s*)(\d{1,3})\s*[.．、]\s*$", t)
            if out and re.match(r"\d{1,3}\.\d", t):
                out[-1] += t
            elif behind:
                out += [behind[1], behind[2] + "."]
            else:
                out.append(x)
        alone = lambda x: re.match(r"\d{1,3}\s*[.．、]\s*$", bare(x))
        for i in range(len(out)):
            if not alone(out[i]):
                continue
            j = i
            while j and (t := bare(out[j - 1])) and not alone(t) and not re.match(r"[A-Ha-h]\s*[.．、]", t) and not re.match("答案|参考答案|解析", t) and _STEM.search(t):
                j -= 1
            stem = [bare(x) for x in out[j:i]]
            if len(stem) <= 4 and sum(map(len, stem)) <= 300:
                out[j : i + 1] = [out[i], *stem]
        text, blank = "", False
        for x in out:
            x = re.sub(r"[ \t]+$", "", re.sub("[\u200b-\u200d\ufeff]", "", x).replace("\u3000", " "))
            if bare(x) or not blank:
                text += (x if bare(x) else "") + "\n"
            blank = not bare(x)
        done.append(text)
    return done


def cleaned(spark, docs):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, pages array<string>")
    return [r[1] for r in rows.select("id", P.clean_pages(F.col("pages"))).orderBy("id").collect()]


LINES = ["下列说法正确的是：", "  能够表明态度的一项。", "1.", "2 、", "13．", "103.", "A. one", "b、two", "答案：A", "3.5 m long", "12.25", "plain words", "words；", "", "  ", "第 3 页，共 10 页", "第１页共２页", "which is it? 4.", "（ ）7、", "？12.", "long：1234.", "tail\u200b \t", "\u3000wide", "要求" + "字" * 290, "head", "1. not alone", "1 2."]


def test_equals_the_plain_loop(spark):
    pick = random.Random(5)
    docs = [["\n".join(pick.choice(LINES) + (str(pick.randrange(9)) if pick.random() < 0.1 else "") for _ in range(pick.randrange(14))) for _ in range(pick.randrange(1, 4))] for _ in range(1500)]
    docs += [["\r\n".join(LINES)], [None, "x"], [""], ["1."], ["下列：\n1.\n2.\n属于\n3."], ["\n".join(["下列：", "以下："] * 300 + ["9."] * 2 + ["a"])]]
    for d, got in zip(docs, cleaned(spark, docs)):
        assert got == plain(d), d


def test_cases(spark):
    assert cleaned(spark, [["head\nthe length is\n3.5 m\nhead", "head\n下列属于的是：2.\nA. one"], [], None]) == [["the length is3.5 m\n", "2.\n下列属于的是：\nA. one\n"], [], None]
    passage = "\n".join(f"材料说明第{k}段。" for k in range(5))
    assert cleaned(spark, [[passage + "\n1."]]) == [[passage + "\n1.\n"]]


def test_cost_follows_the_length(spark):
    """Numbers and stems without end, the fold's worst case."""

    def seconds(n):
        text = "\n".join(f"下列{k}：\n{k % 1000}.\n3.{k}" for k in range(n))
        begun = time.perf_counter()
        assert len(cleaned(spark, [[text]])[0][0]) > n
        return time.perf_counter() - begun

    seconds(500)
    short, long = seconds(4000), seconds(16000)
    assert long < 8 * short + 2
