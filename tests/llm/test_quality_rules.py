import re
from collections import Counter

import pytest

from frameloom.llm import quality_rules


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            repeated.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


GOOD = "A line of prose that simply goes on for some words, as lines do.\nAnother one (with an aside) follows; it is fine: really.\nShort line"
TEXTS = {
    GOOD: True,
    "a b c d e f g h i": False,
    "a b c d e f a b c d e f a b c d e f": False,
    "Home | About | Contact | News | Shop | Help | Search\nOne two three four five six": False,
    GOOD + "\nHome | About | Contact": True,
    " ".join(["WOW!!"] * 3 + [f"BUY{i}!!" for i in range(20)]): False,
    "%% $$ ## && ** (( )) @@ !! ?? ;; ::": False,
    "Please read our Privacy Policy before you go on to use this page here": False,
    GOOD + "\n" + GOOD: False,
}


def test_counts_and_verdicts(spark, odd):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = [r.text for r in docs.collect()]
    rows = quality_rules.rules(docs).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted(map(plain, texts))
    kept = {r.doc_id: r.kept for r in rows if r.n_words}
    assert [kept[100 + i] for i in range(len(TEXTS))] == list(TEXTS.values())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert next(r for r in rows if r.doc_id == 104).cleaned_text == GOOD


def test_no_python_in_the_plan(odd, none):
    found = quality_rules.rules(odd.withColumn("kept", odd.n_chars))
    assert not re.search("Python|Pandas|Arrow|Exchange", found._jdf.queryExecution().executedPlan().toString())
    assert quality_rules.rules(none).count() == 0


@pytest.mark.parametrize("line, fails", [("plain words here", False), ("| | a b", True), ("» one › two three › four", True), ("a|b|c in code and more words here", False), ("Lorem ipsum dolor", True), ("日本語の文章です。", False)])
def test_lines(spark, line, fails):
    row = spark.createDataFrame([(line,)], "line string")
    assert row.select(quality_rules.judged(row.line)["fails"]).first()[0] == fails
