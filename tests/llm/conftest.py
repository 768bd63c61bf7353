import random

import pytest


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents with the odd cases: nulls, empty and repeated rows, copies, long text."""
    draw = random.Random(7)
    words = [f"w{draw.randrange(400)}" for _ in range(3000)]
    texts = [None, "", "one", "\n\n", " \t x \n x\nX ", "aaaa " * 400]
    passage = " ".join(words[:120])
    for at in range(40):
        lines = [" ".join(words[k : k + 9]) + "." for k in range(at * 31, at * 31 + 90, 9)]
        if at % 3 == 0:
            lines.insert(2, "A line that many share.")
        if at % 5 == 0:
            lines.append(passage)
        texts.append("\n".join(lines))
    texts += [texts[10], texts[10], "\n".join(texts[11:31])]
    rows = [(at, text, at % 2, "lost") for at, text in enumerate(texts)]
    rows += [(None, texts[12], 0, "lost"), rows[9]]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, kept string")
