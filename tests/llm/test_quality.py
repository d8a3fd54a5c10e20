import random
import re

from netloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def made():
    r = random.Random(6)
    docs = [None, "", " \n\t", "a", "a b", "a b a b a b", "x\x0by\x0cz\rw", "é日 #$ ☃", "same.\nsame.\n\nsame. \n", "the cat sat " * 40, "Well, word{} is here. ".format(1) * 3]
    for _ in range(60):
        words = ["".join(r.choices("abc", k=r.randint(1, 3))) for _ in range(r.randint(1, 120))]
        docs.append("".join(w + r.choice([" ", " ", ". ", "\n", "\t", "#"]) for w in words))
    docs.append(" ".join(f"w{i}" for i in range(20000)) + ".")
    return list(enumerate(docs)) + [(3, "a"), (3, "a")]


def test_counts_and_base_rule(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as n_words", "'y' as lang")
    out = quality.assess(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in out) == sorted((i, *base(t)) for i, t in docs)
    assert all(not (r["base_failed"] and r["kept"]) for r in out)


def prose(n, start=0):
    return "\n".join(f"Line{i} word{i} has{i} thing{i} near{i} place{i}, so{i} too{i} here{i}." for i in range(start, start + n))


def test_lines_go_and_documents_with_them(spark):
    menu = "Home | About | Contact | Help | News | Shop"
    marks = "Of%%% athe*** erntwh.%%% this&&& reads$$$ as%%% noise###"
    shout = "BUY!! NOW!! CHEAP!! THINGS!! HERE!! TODAY!! OK!!"
    listed = "one two three four five six seven eight nine ten eleven"
    docs = [(1, prose(10)), (2, f"{menu}\n{prose(10)}\n{marks}\nAll rights reserved.\n{shout}\n{listed}"), (3, "\n".join(f"{menu} {i} |" for i in range(20)) + "\n" + prose(1)), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as source")
    out = {r["doc_id"]: r for r in quality.assess(frame).collect()}
    assert [out[i]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert out[2]["cleaned"] == prose(10) and out[1]["cleaned"] == prose(10) and out[4]["cleaned"] is None
    clean = quality.clean(frame)
    assert clean.columns == frame.columns and sorted((r["doc_id"], r["text"]) for r in clean.collect()) == [(1, prose(10)), (2, prose(10))]


def test_empty_table(spark):
    assert quality.assess(spark.createDataFrame([], "doc_id long, text string")).count() == 0
