from talkgrid.functions import spans as S
from talkgrid.operators.windows import repeat_collapse


def test_spans_and_mentions():
    assert S.spans_of("aaaa", "aa") == [(0, 2), (2, 4)] and S.spans_of("x", "") == []
    assert S.fold(" STRASSE ") == S.fold("straße")
    assert S.mentions_of("new york city", {"a": ["york"], "b": ["new york", "new"]}) == [("b", 0, 8)]
    assert S.split_runs("abcdef", [(1, 3, "x"), (2, 4, "y"), (5, 9, "z")]) == [("a", None), ("bc", "x"), ("def", None)]


def test_redaction():
    assert S.redact("see file:///a/b and C:\\Users\\me\\x.txt or /home/me/y /opt/a/b  sk-123 end") == "see <PATH> and <HOME_PATH> or <HOME_PATH> <PATH> <REDACTED> end"
    assert S.redact("字" * 12) == "<TEXT>" and S.redact("字" * 11) == "字" * 11


def test_names():
    assert S.cut_utf8("héé", 4) == ("hé", True) and S.cut_utf8("ab", 4) == ("ab", False)
    assert S.file_name("a/b:c. ", ".md") == "abc.md" and S.file_name("CON", "") == "CON_" and S.file_name("", "-x") == "note-x"
    assert len(S.file_name("字" * 100, "").encode()) <= 160


def test_repeats():
    import pandas as pd

    out = list(repeat_collapse(iter([pd.Series(["ha" * 6, "a" * 8, "a" * 7, "ab" * 5, None, "x" + "yes!" * 7])])))[0].tolist()
    assert out == ["haha", "aa", "a" * 7, "ab" * 5, None, "xyes!yes!"]
