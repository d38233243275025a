import random

import pytest

from planeframe.llm.quotes import OP1_SQL, linked, op1_quotation_links, parse

from ..oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def test_parse_levels():
    own, passages = parse("Hello\nOn Monday Ann wrote:\n> one\n> two\n>> deep\n> > deep too\n> three\nBye")
    assert own == "Hello\nBye"
    assert passages == [(1, "one\ntwo"), (2, "deep\ndeep too"), (1, "three")]
    assert parse(None) == ("", []) and parse("> ")[1] == []


def test_links(spark):
    rows = [
        (1, 0, "u", "The first message here", "x"), (1, 1, "a", "An answer\nof two lines", "x"), (1, 2, "u", "> the FIRST   message here\nI agree", "x"),
        (1, 3, "a", "> of two lines\n>> The first message here\nyes", "x"), (2, 0, "u", "> An answer\n> of two lines\nquoted elsewhere", "x"), (2, 1, "u", "> nobody said this\nhm", "x"),
        (2, None, "u", None, "x"), (None, 0, None, "", "x"), (3, 5, "u", "again", "x"), (3, 5, "u", "again", "x"),
    ]
    out = {(r.conv_id, r.turn, r.text): r for r in linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 9  # one pair of equal rows
    a = out[1, 2, "I agree"]
    assert (a.reply_kind, a.reply_conv, a.reply_turn, a.n_quotes, a.n_linked) == ("quote", 1, 0, 1, 1)
    b = out[1, 3, "yes"]
    assert (b.reply_turn, b.max_level, b.n_linked) == (1, 2, 2)
    c = out[2, 0, "quoted elsewhere"]
    assert (c.reply_kind, c.reply_conv, c.reply_turn) == ("quote", 1, 1)
    d = out[2, 1, "hm"]
    assert (d.reply_kind, d.reply_turn, d.n_linked) == ("previous", 0, 0)
    assert out[2, None, ""].position == 0 and out[None, 0, ""].reply_kind == "first"


def test_other_conversations(spark):
    """The first offer of all may be the quoting conversation's own, too late; null conversations offer and link."""
    rows = [
        (1, 3, "u", "> shared words\nearly", "x"), (1, 9, "a", "shared words", "x"), (2, 0, "a", "shared words", "x"), (3, 1, "a", "shared words", "x"),
        (None, 4, "u", "> shared words\nfrom nowhere", "x"), (None, 1, "a", "said nowhere", "x"), (None, 5, "u", "> said nowhere\nagain", "x"), (4, 0, "u", "> said nowhere\nelsewhere", "x"),
    ]
    out = {r.text: (r.reply_kind, r.reply_conv, r.reply_turn) for r in linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["early"] == ("quote", 2, 0)
    assert out["from nowhere"] == ("quote", 1, 9)
    assert out["again"] == ("quote", None, 1) and out["elsewhere"] == ("quote", None, 1)


def test_trimmed_quotes(spark):
    """Two lines of three, two paragraphs of three, wrapped anew; not lines of different places or messages."""
    rows = [
        (1, 0, "u", "alpha one\nbeta two\ngamma three", "x"), (1, 1, "a", "first para\n\nsecond para\nof two lines\n\nthird para", "x"), (1, 2, "u", "alpha one\nelse", "x"),
        (1, 3, "u", "> Beta  two\n> gamma three\nlast lines", "x"), (1, 4, "u", "> second para of\n> two lines\n>\n> third para\nlast paragraphs", "x"),
        (1, 5, "u", "> alpha one\n> gamma three\nwith a gap", "x"), (1, 6, "u", "> gamma three\n> first para\nover messages", "x"), (2, 0, "u", "> alpha one\n> beta two\nelsewhere", "x"),
        (2, 1, "u", "> alpha one\n> beta two\n> gamma three\n> more\ntoo long", "x"),
    ]
    out = {r.text: (r.reply_kind, r.reply_conv, r.reply_turn, r.n_linked) for r in linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["last lines"] == ("quote", 1, 0, 1) and out["last paragraphs"] == ("quote", 1, 1, 1) and out["elsewhere"] == ("quote", 1, 0, 1)
    assert out["with a gap"] == ("previous", 1, 4, 0) and out["over messages"] == ("previous", 1, 5, 0) and out["too long"] == ("previous", 2, 0, 0)


def test_positions_are_gapless_over_ranges(spark):
    rows = [(7, t, "u", f"m{t}", "x") for t in range(0, 5000, 3)]
    out = sorted((r.turn, r.position, r.reply_turn) for r in linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [p for _, p, _ in out] == list(range(len(rows)))
    assert [b for _, _, b in out][1:] == [t for t, _, _ in out][:-1]


def test_empty(spark):
    assert linked(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", (9, 10))
def test_against_sql(spark, tmp_path, seed):
    """Random threads with nested quotes, null conversations and turns, turns and whole rows that repeat; the SQL over the same table."""
    rng = random.Random(seed)
    said, rows = ["hello there", "one\ntwo lines", "para one\n\npara two"], []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                mark = rng.choice(["> ", ">> ", "> > ", ">", "  > "])
                lines += (["On Monday someone wrote:"] if rng.random() < 0.3 else []) + [mark + x.upper() for x in rng.choice(said).split("\n")]
                if rng.random() < 0.5:
                    lines.append(f"word {rng.randint(0, 30)}")
            lines.append(rng.choice(["ok", f"new text {conv} {turn}", "", "wrote:"]))
            text = rng.choice(["\n", "\r\n"]).join(lines)
            said.append(parse(text)[0] or "ok")
            at = None if rng.random() < 0.05 else turn // 2 if conv % 3 == 0 else turn
            rows += [(None if conv == 11 else conv, at, rng.choice(["u", "a", None]), text if rng.random() < 0.95 else None)] * (2 if rng.random() < 0.1 else 1)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    compare(spark, str(tmp_path), op1_quotation_links, OP1_SQL)
