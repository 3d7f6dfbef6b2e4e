import random
import re
import textwrap

from maskwright.llm import quotations as Q


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    return Q.conversations(df).collect()


def test_threads(spark):
    ask, other = "How do I plane a warped board flat by hand?", "Which glue is best for wet wood outside?"
    reply = "Use winding sticks and work across the grain first."
    rows = [
        (1, 0, "user", ask),
        (1, 1, "user", other),
        (1, 2, "assistant", f"On Monday, a user wrote:\n> {ask.upper()}\n{reply}"),
        (1, 3, "assistant", f"> {other}\nEpoxy or polyurethane."),
        (1, 4, "user", f">> {ask}\n> {reply}\nThanks, that worked very well for me."),
        (1, 5, "user", f"> > > {ask}\n> > {reply}\n> Thanks, that worked very well for me.\nGood to hear."),
        (1, 6, "user", "> this line was never said by anyone\nHm."),
        (2, 0, "user", f"> {ask}\nA quote from another conversation."),
    ]
    got = [(r.conv_id, r.thread, r.turn, r.reply_to, r.depth) for r in run(spark, rows)]
    assert got == [(1, 0, 0, None, 0), (1, 0, 2, 0, 1), (1, 0, 4, 2, 2), (1, 0, 5, 4, 3), (1, 1, 1, None, 0), (1, 1, 3, 1, 1), (1, 6, 6, None, 0), (2, 0, 0, None, 0)]
    texts = {(r.conv_id, r.turn): r.text for r in run(spark, rows)}
    assert texts[1, 2] == reply and texts[1, 5] == "Good to hear." and not any(">" in t for t in texts.values())


def test_edges(spark):
    line = "the very same line again and again"
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", line), (1, 3, "user", line), (1, 4, "a", f"> {line}"), (1, 4, "a", f"> {line}"), (None, 5, "a", f"> {line}"), (1, None, "a", f"> {line}"), (3, 0, "a", "x" * 100000)]
    got = {(r.conv_id, r.turn, r.reply_to, r.role) for r in run(spark, rows)}
    assert got == {(1, 0, None, "unknown"), (1, 1, None, "user"), (1, 2, None, "user"), (1, 3, None, "user"), (1, 4, 3, "a"), (None, 5, None, "a"), (1, None, None, "a"), (3, 0, None, "a")}
    assert len(run(spark, rows)) == len(rows)
    assert run(spark, []) == []


def norm(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def brute_parents(rows):
    """The rule as loops, for rows (conv, turn, text)."""

    def units(text):
        out, last = [], None
        for line in text.split("\n"):
            marks = re.match(r"\s*((?:>\s?)*)", line).group(1)
            level, bare = marks.count(">"), re.sub(r"^\s*(?:>\s?)*", "", line)
            if not norm(bare):
                last = None
            elif last is not None and last[0] == level:
                last[1] += " " + bare
            else:
                last = [level, bare]
                out.append(last)
        whole = {(level, norm(x)) for level, p in out for x in [p, *re.split(r"(?<=[.!?])\s*(?=\S)", p)] if norm(x)}
        return whole | {(level, " ".join(x.split(" ")[:8])) for level, x in whole}

    found = {(c, t): units(x) for c, t, x in rows}
    parents = {}
    for (c, t), mine in found.items():
        votes = {}
        for level, x in mine:
            last = max((u for (d, u), theirs in found.items() if d == c and u < t and (0, x) in theirs), default=None)
            if level and last is not None:
                votes[level, last] = votes.get((level, last), 0) + len(x)
        parents[c, t] = max(votes, key=lambda k: (-k[0], votes[k], k[1]))[1] if votes else None
    return parents


def test_generated_quotes_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    sentence = lambda: " ".join(rng.choice("old boat river stone lamp under over green seven cold".split()) for _ in range(rng.randrange(2, 12))).capitalize() + rng.choice(".!?")
    for conv in range(12):
        said = []
        for turn in range(15):
            own = "\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
            body = textwrap.fill(own, rng.choice([20, 60, 300])) if "\n\n" not in own else own
            quote = ""
            if turn and rng.random() < 0.8:
                source = rng.choice(said)
                lines = [x for x in source.split("\n") if x.strip()]
                kind = rng.randrange(4)
                part = rng.choice(lines) if kind == 0 else "\n".join(lines)
                if kind == 2 and not any(x.startswith(">") for x in lines):  # wrapped anew
                    part = textwrap.fill(" ".join(lines), 25)
                if kind == 3:  # breaks off in mid sentence
                    part = part[: rng.randrange(20, 200)]
                quote = "She wrote:\n" + "\n".join("> " + x if not x.startswith(">") else ">" + x for x in part.split("\n")) + "\n"
            said.append(quote.removeprefix("She wrote:\n") + body)
            rows.append((conv, turn, quote + body))
    got = {(r.conv_id, r.turn): r.reply_to for r in run(spark, [(c, t, "user", x) for c, t, x in rows])}
    want = brute_parents([(c, t, x.removeprefix("She wrote:\n")) for c, t, x in rows])
    assert got == want and sum(p is not None for p in want.values()) > 60


def test_wrapped_anew_and_short(spark):
    long = "The ridge path is closed in winter. Take the lower road past the mill, and leave before noon. Call me then."
    rows = [(1, 0, "a", long), (1, 1, "b", "> The ridge path is closed in\n> winter. Take the lower road past\n> the mill, and leave before noon.\n> Call me then.\nFine."), (1, 2, "a", "> Fine.\nGood."), (1, 3, "b", "> Take the lower road past the mill,\n> and leave before noon.\nWhy?"), (1, 4, "a", "one\ntwo\nthree"), (1, 5, "b", "> one two three\nfour")]
    assert [(r.turn, r.reply_to) for r in sorted(run(spark, rows), key=lambda r: r.turn)] == [(0, None), (1, 0), (2, 1), (3, 0), (4, None), (5, 4)]


def test_any_number_of_quote_marks(spark):
    rows = [(1, 0, "a", "Said once."), (1, 1, "b", ">" * 1_000_000 + " deep\n> Said once."), (1, 2, "b", "> " * 300_000 + "x"), (1, 3, "a", " " * 500_000 + "\n" * 200_000 + "> Said once.\nYes."), (1, 4, "a", ">" * 3000)]
    got = {r.turn: (r.reply_to, r.text, r.quoted_lines) for r in run(spark, rows)}
    assert got == {0: (None, "Said once.", 0), 1: (0, "", 2), 2: (None, "", 1), 3: (0, "Yes.", 1), 4: (None, "", 1)}


def test_nearest_holder_and_quotes_cut_off(spark):
    long = "The ridge path over the old bridge is closed in winter because of ice on the steps."
    rows = [(1, 0, "a", "Thanks."), (1, 1, "b", "Thanks."), (1, 2, "a", "> Thanks.\nWhat for?"), (1, 3, "b", long), (1, 4, "a", "> The ridge path over the old bridge is closed in\nSince when?"), (1, 5, "b", "> The ridge path\nWhich?")]
    assert {r.turn: r.reply_to for r in run(spark, rows)} == {0: None, 1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_folded_and_distant_introductions_go(spark):
    rows = [(1, 0, "a", "One thing."), (1, 1, "b", "On Mon, 3 Feb 2020, Ann Other\n<ann@example.org> wrote:\n> One thing.\nYes."), (1, 2, "b", "Ann wrote:\n\n> One thing.\nNo."), (1, 3, "b", "On we go\nas she wrote: so\n> One thing.\nMaybe.")]
    assert {r.turn: r.text for r in run(spark, rows)} == {0: "One thing.", 1: "Yes.", 2: "No.", 3: "On we go\nas she wrote: so\nMaybe."}
