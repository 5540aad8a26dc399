"""Style allocation against the passes written out over plain lists."""

import random

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.operators import styles as Y
from voxtable.operators.lines import BIG_STYLES, STYLE_GAP, STYLE_WORDS, carries, norm, strongest
from voxtable.operators.ordered import find_hot

LINE = "video_id bigint, line_id bigint, start_ms bigint, text string, weight int, kind string, key_note string, mood string, icon string, cta boolean, loud boolean"
TEXTS = [
    "big idea", "rejections", "the core depth matters", "we made 5 million", "so what", "it is", "growth comes from focus",
    "a very long plain line here", "hello friends today works", "Systems win!", "quoted wisdom stays", "costs exploded",
]


def talk(seed, n):
    rnd, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice([700, 1200, 1500, 2600])
        text = rnd.choice(TEXTS)
        out.append(
            (seed, i, t, text, rnd.randrange(4), rnd.choice(["concept", "term", "drama", "quote", "payoff", "normal"]), rnd.choice(text.split() + [""]),
             rnd.choice(["neutral", "neutral", "surprise"]), "none", rnd.random() < 0.1, rnd.random() < 0.1)
        )
    return out


def fitting_key(text, key):
    return key if carries(text.split(), key) else ""


def brute(rows, look):
    """Passes up to the mix words, for keys of at most one word and lines without greetings."""
    n = len(rows)
    text, time, w = [r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows]
    kind, key = [r[5] for r in rows], [fitting_key(r[3], r[6]) for r in rows]
    strong = [k or strongest(t.split()) for k, t in zip(key, text)]
    size = [len(t.split()) for t in text]
    content = [sum(norm(x) not in rules.FILLER for x in t.split()) for t in text]
    style, gone = ["plain"] * n, set()
    designed = {*BIG_STYLES, "underline"}

    def clear(i, s):
        for j in range(n):
            if j != i and style[j] != "plain":
                d = abs(time[i] - time[j])
                if (style[j] == s and d < STYLE_GAP.get(s, 0)) or (s in designed and style[j] in designed and d < 3000):
                    return False
        return True

    free = lambda i: style[i] == "plain" and i not in gone
    near = [i for i in range(min(3, n)) if time[i] - time[0] <= 2500]
    good = [i for i in near if any(len(norm(x)) >= 3 and norm(x) not in rules.FILLER + rules.GREETINGS for x in text[i].split())]
    h = (good or near)[0]
    if h + 1 < n and size[h] <= 3 and size[h + 1] <= 4 and time[h + 1] - time[h] <= 1800 and text[h][-1] not in ".?!":
        style[h] = "stack"
        gone.add(h + 1)
    else:
        style[h] = "serif" if size[h] <= 4 else "mix" if strong[h] else "plain"
    by_weight = sorted(range(n), key=lambda i: (-w[i], time[i]))
    by_rank = sorted(range(n), key=lambda i: (-w[i], -content[i], time[i]))
    money = lambda t: "million" in t

    def take(order, test, styles, stop=lambda s: False):
        for i in order:
            if free(i) and test(i):
                for s, fit in styles(i):
                    if not stop(s) and fit and clear(i, s):
                        style[i] = s
                        break

    take(range(n), lambda i: money(text[i]), lambda i: [("chip", size[i] <= 4)])
    take(range(n), lambda i: (rows[i][10] and w[i] >= 1) or (rows[i][7] == "surprise" and w[i] >= 2), lambda i: [("chip", size[i] <= 4)])
    if look == "premium":
        take(range(n), lambda i: rows[i][9], lambda i: [("bubble", size[i] <= 4)])
    accents = {
        "concept": lambda i: [("oval", size[i] <= 3), ("underline", size[i] <= 4 and key[i] != "")],
        "term": lambda i: [("underline", size[i] <= 4 and key[i] != "")],
        "drama": lambda i: [("tape", size[i] <= 3 and key[i] != "")],
        "quote": lambda i: [("quote", 2 <= size[i] <= 5)],
    }
    take(by_weight, lambda i: w[i] >= 2 and kind[i] in accents and (w[i] == 3 or kind[i] != "concept"), lambda i: accents[kind[i]](i))
    take(by_weight, lambda i: w[i] >= 2 and not (kind[i] == "normal" and w[i] < 3), lambda i: [("serif", size[i] <= 4)])
    window = [i for i in by_rank if time[i] - time[0] < 30_000]
    for s in ("oval", "underline"):
        if not any(style[i] == s for i in window):
            have = lambda x: any(style[i] == x for i in window)
            take(window, lambda i: w[i] >= 1 and len(norm(strong[i])) >= 4, lambda i: [(s, size[i] <= STYLE_WORDS[s])], have)
    seconds = max(time[-1] - time[0], 1000)
    for s, per, least in Y.FILL:
        full = lambda x: style.count(x) >= round(seconds / per)
        take(by_rank, lambda i: w[i] >= 1 and len(norm(strong[i])) >= least, lambda i: [(s, size[i] <= STYLE_WORDS[s])], full)
    for i in range(n):
        if free(i) and key[i] and (w[i] >= 2 or i == 0 or style[i - 1] == "plain" or len(norm(key[i])) >= 7):
            style[i] = "mix"
    mixes = [i for i in range(n) if style[i] == "mix"]
    emphasis = {i: strong[i] if i == h else key[i] for i in mixes}
    for i in sorted(mixes, key=lambda i: (w[i], len(norm(emphasis[i]))))[: max(0, len(mixes) - int(0.45 * n))]:
        style[i] = "plain"
    return style


def test_allocation_equals_the_passes(spark):
    rows = [r for seed in range(12) for r in talk(seed, 5 + 9 * seed)]
    rows = [r for r in rows if not (r[1] <= 1 and r[3].startswith("hello"))]
    # line ids stay dense
    seen, dense = {}, []
    for r in rows:
        dense.append((r[0], seen.setdefault(r[0], 0), *r[2:]))
        seen[r[0]] += 1
    df = spark.createDataFrame(dense, LINE)
    for look in ("classic", "premium"):
        out = Y.allocate_styles(df, look).orderBy("video_id", "line_id").collect()
        got = {}
        for r in out:
            got.setdefault(r.video_id, []).append(r.style)
        for v in got:
            assert got[v] == brute([r for r in dense if r[0] == v], look), (look, v)


def test_allocation_does_not_depend_on_the_split(spark):
    df = spark.createDataFrame(talk(7, 80) + talk(8, 5), LINE)
    pick = lambda h: sorted(tuple(r) for r in Y.allocate_styles(df, "classic", h).select("video_id", "line_id", "style", "emphasis", "shown_mood").collect())
    assert pick(find_hot(df, ["video_id"])) == pick(find_hot(df, ["video_id"], 30))


def test_absorbed_lines_go(spark):
    df = spark.createDataFrame(talk(3, 30), LINE)
    styled = Y.allocate_styles(df)
    out = Y.absorb_stacks(styled)
    n = styled.filter("absorbed").count()
    assert out.count() == 30 - n and out.filter(F.col("sub") != "").count() == n
