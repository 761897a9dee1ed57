"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, norm string, part int"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def sentence(n, step=7):
    return " ".join(WORDS[(i * step + i // 3) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


TEXTS = [
    None, "", " ", "Hello World", "hello world", "HELLO WORLD", "héllo É", "HÉLLO é", sentence(120), sentence(120), sentence(121),
    sentence(120) + " tail", "x" * 6000, "日本語のテキスト、🙂 123", "a<|endoftext|>b", "a\x00b\u0085c", sentence(4000, 11), "don't  stop \n\n\t now",
    "one", "one two three", "=" * 3000, "12345 67890 ½²", "İstanbul ǅ ﬁ", "0" * 5000 + ".0.0.0", "½", "Ⅷ",
]


def rows():
    out = [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", 1) for i, t in enumerate(TEXTS)]
    return out + [out[3], (None, "hello world", None, None, 1, None, None, None)]


def frames(spark):
    return spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
