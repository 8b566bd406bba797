"""Plain versions of the corpus operators, a document at a time."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed(texts, window):
    """Words that are left of each text, and how many went."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(ws[i:i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append(([w for i, w in enumerate(ws) if i not in gone], len(gone)))
    return out


def shingles(text):
    ws = words(lower(text))
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)}


def components(rows, percent=75):
    """Component of each (id, text): smallest id reachable."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [min(least[find(i)]) for i in range(len(rows))], [len(s) for s in sets]


def base_counts(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    repeat = set()
    for i in range(len(ws) - 2):
        if seen[tuple(ws[i:i + 3])] > 1:
            repeat.update(range(i, i + 3))
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat)}


# Shared inputs.
SCHEMA = "doc_id long, text string, lang string, row string, id string, ids string, kept string, score string, node string, _ranges string"


def made_texts():
    """Texts with copies, shared passages, symbols, repeated lines, long and odd ones."""
    rng = random.Random(7)
    vocabulary = [a + b for a in "the an é ß ou ti".split() for b in "ra lo mi nde st".split()]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(70)
    texts = [None, "", "   ", "\n\t ", "one", "One", "two words", "a b c d", "A b c d", "a b c d e"]
    base = prose(120)
    texts += [base, base, base.upper(), base.capitalize(), base + " tail", base.replace(" ", "  ", 3)]
    near = base.split(" ")
    for i in range(12):
        copy = list(near)
        copy[i * 9] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [f"{prose(30)} {passage} {prose(40)}" for _ in range(8)]
    texts += [f"{prose(5)}\n{prose(4)}\n{prose(5)}" for _ in range(10)]
    texts += ["line x\n" * 30 + "end", "same " * 200, "### | $$$ <a> & % * " * 20, "x" * 5000,
              "中文字符没有空格" * 50, prose(6000), "AB 	 cd\x0b\x0cef\rgh \x1f i", "tab\tsep " * 40,
              "naïve café " * 30, "<|endoftext|> is plain text", "\u00a0 \u2003 wide spaces"]
    return texts


def frame(spark, pairs):
    full = [(d, t, "en", "r", "i", "x", "k", "s", "n", "q") for d, t in pairs]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
