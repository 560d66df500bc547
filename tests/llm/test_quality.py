"""The method's half of the quality rules against brute force: both distances and the verdict."""

import math
import random
import re
import unicodedata

import pytest

from gradewright.llm import quality

STOP = set(".,;:!?'\"()-。、，！？：；（）「」『』،؛؟।")


def distance(counts, total, shares):
    out = 0.0
    for n, q in zip(counts, shares):
        p = n / total
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(max(out, 0.0))


def char_class(c):
    if c in " \t\n\x0b\x0c\r":
        return 4
    if c in STOP:
        return 5
    kind = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Me": 2, "Nd": 3}.get(kind, 6)


def expected(text, lang):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {j for v in grams.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    base = len(words) < 10 or 100 * len(again) > 20 * len(words)
    shares = next((r for r, ls in quality.SCRIPTS if lang in ls), None)
    a = b = None
    if shares and len(text) >= quality.MIN_CHARS:
        counts = [0] * 7
        for c in text:
            counts[char_class(c)] += 1
        a = distance(counts, len(text), shares)
    if lang in quality.COMMON and len(words) >= quality.MIN_WORDS:
        low = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
        counts = [low.count(w) for w in quality.COMMON[lang]]
        b = distance([*counts, len(words) - sum(counts)], len(words), (*quality.WORD_SHARES, 1 - sum(quality.WORD_SHARES)))
    far = (a or 0) > quality.MAX_CLASS_DISTANCE or (b or 0) > quality.MAX_WORD_DISTANCE or (a is not None and b is not None and (a + b) / 2 > quality.MAX_MEAN_DISTANCE)
    return len(again), a, b, not base and not far


def cases():
    rng = random.Random(8)
    out = [(None, "en"), ("", None), ("x " * 400, "en"), ("word " * 4, "en")]
    for lang in (*quality.COMMON, "ru", "zh", "xx", None):
        common = quality.COMMON.get(lang, ["der", "die"])
        alphabet = {"ru": "оеаинтсрвл", "zh": "的一是不了人我在有他"}.get(lang, "etaoinsr")
        for share in (0.0, 0.3, 0.6):
            for _ in range(4):
                words = [rng.choice(common) if rng.random() < share else "".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(rng.choice((12, 70, 90, 300)))]
                out.append((("" if lang == "zh" else " ").join(words) + rng.choice(("", ".", " #### ## 12345 $$$$" * 30)), lang))
    return out


def test_distances_and_verdict(spark):
    rows = [(i, t, lang, "clash") for i, (t, lang) in enumerate(cases())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __extra string")
    got = {r.doc_id: r for r in quality.rules(docs).collect()}
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    for i, t, lang, _ in rows:
        n, a, b, keep = expected(t, lang)
        g = got[i]
        assert (g.n_repeat_words, g.kept, i in kept) == (n, keep, keep), (i, lang, a, b, g)
        for x, y in ((g.class_distance, a), (g.word_distance, b)):
            assert x is None and y is None or x == pytest.approx(y, abs=1e-9)


def test_other_scripts_are_kept(spark):
    """Clean prose of other scripts; and letters of any script where the language says otherwise are rejected."""
    ru = "Вечером старый рыбак вернулся домой, и дети выбежали ему навстречу, потому что давно ждали его на берегу. " * 1 + "Он рассказал им о далёких островах, где живут большие птицы, и о том, как однажды ночью волна унесла его лодку. " + "Никто не знал, правда ли это, но слушали все, и даже бабушка отложила вязание. " * 1 + "Потом они пили чай с мёдом, смотрели на звёзды и говорили о завтрашнем дне, когда снова надо будет рано вставать."
    zh = "傍晚的时候，老渔夫回到了家里，孩子们都跑出来迎接他，因为他们已经在岸边等了很久。他给大家讲了远方岛屿的故事，那里住着很大的鸟，还讲了有一天夜里海浪怎样卷走了他的小船。没有人知道这是不是真的，但是所有的人都在听，连奶奶也放下了手里的毛线。后来他们喝着加了蜂蜜的茶，看着天上的星星，谈论明天的事情，因为明天又要很早起床。" * 1 + "村子里的灯一盏一盏地熄灭了，只有码头上的那盏灯还亮着。风从海上吹来，带着盐和海草的味道，远处传来轮船的汽笛声。小女儿靠在父亲的肩膀上睡着了，梦见自己也坐着船去了那些岛屿，和大鸟一起在云里飞。第二天早上，太阳升起来的时候，渔夫已经把网修好了，准备再一次出海。孩子们站在岸上向他挥手，直到小船消失在地平线上，变成一个小小的黑点。他们相信父亲一定会带着新的故事回来，就像每一次那样，平安地回到这个温暖的家。"
    d = spark.createDataFrame([(1, ru, "ru"), (2, " ".join(zh[i : i + 20] for i in range(0, len(zh), 20)), "zh"), (3, ru, "xx"), (4, ru * 3, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.rules(d).collect()} | {4: None} == {1: True, 2: True, 3: True, 4: None}
