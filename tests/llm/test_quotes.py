import random
import re
import time
from collections import Counter, defaultdict

from folioscope.llm import quotes

COLUMNS = "conv_id bigint, turn bigint, role string, text string, at string, conv string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS).repartition(2)


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def units(text):
    """Level and normalised text of the lines and passages of a message."""
    found, run, level_of = set(), [], None
    for line in [*re.split(r"\r?\n", text or ""), ""]:
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level, body = marks.count(">"), normal(line[len(marks) :])
        if run and (level != level_of or not body):
            found.add((level_of, " ".join(run)))
            run = []
        if body:
            found.add((level, body))
            run, level_of = [*run, body], level
    return found


def brute(rows):
    """conv, turn -> reply_to, root, depth, n_quotes, n_linked."""
    messages = defaultdict(set)
    for conv, turn, _, text in rows:
        messages[conv, turn] |= units(text)
    order = lambda t: float("-inf") if t is None else t
    origin = {}
    for (conv, turn), found in sorted(messages.items(), key=lambda x: order(x[0][1])):
        for level, body in found:
            if level == 0:
                origin.setdefault((conv, body), turn)
    parent, counts = {}, {}
    for (conv, turn), found in messages.items():
        votes, linked = Counter(), 0
        quoted = [(level, body) for level, body in found if level]
        for level, body in quoted:
            if (conv, body) in origin and order(origin[conv, body]) < order(turn):
                linked += 1
                if level == 1:
                    votes[origin[conv, body]] += len(body)
        counts[conv, turn] = (len(quoted), linked)
        parent[conv, turn] = max(votes, key=lambda t: (votes[t], order(t))) if votes else "none"
    out = {}
    for conv, turn in messages:
        root, depth = turn, 0
        while parent[conv, root] != "none":
            root, depth = parent[conv, root], depth + 1
        answered = parent[conv, turn]
        out[conv, turn] = (None if answered == "none" else answered, root, depth, *counts[conv, turn])
    return out


def check(spark, rows):
    found = quotes.reply_order(frame(spark, rows)).collect()
    wanted = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.reply_to, r.root, r.depth, r.n_quotes, r.n_linked) == wanted[r.conv_id, r.turn], (r.conv_id, r.turn)
        assert not re.search(r"^[ \t]*>", r.text, re.M)
    place = defaultdict(dict)
    for i, r in enumerate(found):
        place[r.conv_id].setdefault(r.turn, i)
    for r in found:
        if r.reply_to is not None:
            assert place[r.conv_id][r.reply_to] < place[r.conv_id][r.turn]
    return found


def test_links_by_definition(spark):
    draw = random.Random(12)
    lines = ["Hello there.", "How are you?", "Fine, thanks!", "ÉTÉ à Paris", "42 is it", "Let us go on"]
    rows = []
    for conv in range(8):
        texts = []
        for turn in range(draw.randint(1, 15)):
            parts = ["\n".join(draw.choice(lines) + f" {draw.randint(0, 3)}" for _ in range(draw.randint(0, 3)))]
            for _ in range(draw.randint(0, 2)):
                if texts:
                    quoted = draw.choice(texts).split("\n")
                    parts.insert(0, "\n".join(draw.choice([">", "> ", " >"]) + x for x in quoted[: draw.randint(1, 4)]))
            texts.append(draw.choice(["\n", "\n\n", "\r\n"]).join(parts))
            rows.append((conv, turn * 3, "user", texts[-1]))
    rows += [(None, None, None, None), (None, 1, "user", "> x\ny"), (50, None, "user", "first words"), (50, 0, "user", "> first words\nok")]
    rows += [(51, 0, "user", ""), (51, 1, "user", ">"), (51, 1, "user", "> \n>>"), rows[3], (52, 0, "user", "line of it\n" * 20_000)]
    check(spark, rows)


def test_rewrapped_nested_and_partial_quotes(spark):
    rows = [
        (1, 0, "user", "The first message is long,\nand has two lines.\n\nAnother part."),
        (1, 1, "user", "> The first message is long, and has two\n> lines.\n\nAn answer."),
        (1, 2, "user", ">> Another part.\n> An answer.\nDone"),
        (1, 3, "user", "> Another part.\nTo the first"),
        (1, 4, "user", "No quote"),
    ]
    found = {r.turn: r for r in check(spark, rows)}
    assert [found[t].reply_to for t in range(5)] == [None, 0, 1, 0, None]
    assert [found[t].depth for t in range(5)] == [0, 1, 2, 1, 0]
    assert found[1].text == "An answer." and found[2].n_linked == 2


def test_long_chain_in_one_conversation(spark):
    rows = [(1, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(120)]
    found = check(spark, rows)
    assert [r.turn for r in found] == list(range(120)) and found[-1].depth == 119


def test_empty_table(spark):
    assert quotes.reply_order(frame(spark, [])).collect() == []


def test_main_path_has_no_python(spark):
    df = quotes.reply_order(frame(spark, [(1, 0, "user", "a"), (1, 1, "user", "> a\nb")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hostile_texts_take_time_in_proportion(spark):
    n = 10**6
    texts = ["first\n\n" + "\n" * n + "last", ">" * n + " x", "> " * n, " " * n, "a" + " " * 100_000 + "b", "\n \t" * n + "x", "> a\n" * 50_000]
    rows = [(1, i, "u", t) for i, t in enumerate(texts)]
    start = time.time()
    found = {r.turn: r for r in quotes.reply_order(frame(spark, rows)).collect()}
    assert len(found) == len(texts) and time.time() - start < 120
    own = {r.turn: r.own for r in frame(spark, rows).select("turn", quotes.own_text(quotes.F.col("text")).alias("own")).collect()}
    assert own[0] == "first\n\nlast" and own[1] == own[2] == own[3] == own[6] == "" and own[5] == "x"
