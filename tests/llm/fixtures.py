"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeats, odd white space."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, doc long, print long, label int"


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["The", "ÀÉ", "naïve", "don't", "日本", "x-y", "1,234"]
    passage = " ".join(rnd.choice(vocab) for _ in range(80))
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 220))) for _ in range(n)]
    out = list(base)
    out += [base[3], base[3], base[7] + " tail", "\n".join(base[:4])]
    out += [" ".join(base[i].split()[:40] + passage.split() + base[i].split()[40:]) for i in range(8, 20)]
    out += [None, "", " ", "\n\t ", "one", "Two words", "a b c", "a  b c d 　 e\n\nf \n g\r\nh", "x" * 5000, "same " * 3000, "\x1c a \x1d b\x85c"]
    long = base[11].split()
    out += [" ".join(long * 60), " ".join((long * 60)[5:])]
    near = base[12].split()
    for k in range(0, 6):
        out.append(" ".join(near[:k] + ["edit"] + near[k + 1 :]))
    return out


def rows(seed=1):
    found = [(i + 1, t, "en", f"s{i % 5}" if i % 11 else None, None, 7, 1, 2, 0) for i, t in enumerate(texts(seed))]
    found.append((None, texts(seed)[3], None, None, None, None, None, None, None))
    found.append(found[4])  # a repeated row
    found.append((5, "another text under an id that is there", "en", "s1", 1, 1, 1, 1, 1))
    random.Random(seed).shuffle(found)
    return found
