import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import chats
from quillmesh.llm.chats import INSTRUCT

NASTY = [*INSTRUCT.control, "\\", "<", "[", "/", ">", "]", " ", "\n", "é", "😀", "INST", "SYS", "<<<SYS>>", "\\[INST]", "[\\INST]", "[[/INST]]"]
TEXT = st.lists(st.sampled_from(NASTY) | st.text(max_size=3), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]"]) | TEXT, TEXT), max_size=6))
def test_whole_conversations_are_read_back(turns):
    """From the text of all segments joined; no control string is left within a text."""
    made = [INSTRUCT.segments(r, t) for r, t in turns]
    assert list(INSTRUCT.turns("".join(s for turn in made for s, _ in turn))) == turns
    for (r, t), turn in zip(turns, made, strict=True):
        assert not any(c in turn[1][0] for c in INSTRUCT.control)
        assert "".join(INSTRUCT.plain(s) for s, loss in turn if loss) == (t if r == "assistant" else "")


def test_other_templates():
    """Control strings that overlap are broken too; marks without a control string are refused."""
    overlapping = chats.Template({"q": chats.Marks("xyx:", ":yxy", True)}, ("xyx=", "yxy=", "yxy;"), {("start", "q"): "start"}, ("xyx", "yxy"), escape="~")
    for text in ("xyxyxyx", "~xyx~~yxy~", "yxyxy", "~", "", "xy~x"):
        formatted = "".join(s for s, _ in overlapping.segments("q", text))
        assert list(overlapping.turns(formatted)) == [("q", text)]
        assert not any(c in overlapping.escaped(text) for c in overlapping.control)
    with pytest.raises(ValueError, match="each mark"):
        chats.Template({"q": chats.Marks("", "</s>")}, INSTRUCT.named, {}, INSTRUCT.control)
    with pytest.raises(ValueError, match="escape"):
        chats.Template({}, INSTRUCT.named, {}, (*INSTRUCT.control, "a\\"))


@pytest.mark.parametrize(("roles", "order", "ended"), [
    ("system user assistant user assistant", "11111", True), ("user assistant", "11", True), ("user", "1", False), ("assistant user assistant", "011", True),
    ("user user assistant assistant", "1010", True), ("user tool assistant", "101", True), ("user system assistant", "100", True), ("tool", "0", False),
])
def test_machine(roles, order, ended):
    state, got = INSTRUCT.start, ""
    for r in roles.split():
        state, known = INSTRUCT.step(state, r)
        got += str(int(known))
    assert got == order and (state in INSTRUCT.ends) is ended


def _plain(rows):
    """From the rows themselves, but for formatted_chars, which counts marks and escapes."""
    out, talks = {}, {}
    for c, n, r, t in rows:
        talks.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    for c, turns in talks.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        chars = sum(len(s) for *_, r, t in turns for s, _ in INSTRUCT.segments(r, t))
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said), chars)
    return out


def test_equals_a_plain_version(spark):
    r = random.Random(5)
    rows = [(c, n, r.choice(["user", "assistant", "system", "tool", None, "a\nb", "[/ROLE] "]), r.choice([None, "", "x", "</s>[INST] ok [/INST]", "\\\\", "[\\INST]" * 3])) for c in range(60) for n in range(c % 9)]
    rows += [(3, 0, "user", "tie"), (3, 0, "assistant", "tie"), *[(3, 1, "user", "twice")] * 2, (5, None, "user", "first"), (None, 0, "user", "none"), (None, 1, "assistant", "none"), (7, 1, "assistant", "long ☃ </s>" * 200_000)]
    rows += [(100, n, "user" if n % 2 == 0 else "assistant", f"hot {n}") for n in range(3000)]  # more turns than a batch holds
    turns = spark.createDataFrame([(*x, "q", "w") for x in rows], "conv_id long, turn long, role string, text string, state string, segments string").repartition(5)
    made = chats.format_chats(spark, turns)
    assert made.columns == ["conv_id", "pos", "state", "expected", "segments"]
    read = lambda df: {x.conv_id: tuple(x)[1:6] for x in df.collect()}
    assert read(chats.read_back(made)) == _plain(rows)
    assert read(chats.read_back(made.repartition(7), together=False)) == _plain(rows)
    hot = chats.read_back(made).filter("conv_id = 100").first()
    assert hot.in_order and hot.ended
    assert chats.read_back(chats.format_chats(spark, turns.limit(0))).count() == 0
