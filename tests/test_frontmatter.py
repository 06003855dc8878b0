"""Front matter read by Spark and by the helper, against one reader in Python."""

import random

import yaml
from pyspark.sql import functions as F

from runlore.functions.frontmatter import _PLAIN, frontmatter, read_block


def split(text):
    """The block between the fences, or None, and the body."""
    lines = (text or "").splitlines(keepends=True)
    fences = [i for i, line in enumerate(lines) if line.strip() == "---"]
    head = next((i for i, line in enumerate(lines) if line.strip()), None)
    if not fences or fences[0] != head or len(fences) < 2:
        return None, text or ""
    return "".join(lines[head + 1 : fences[1]]), "".join(lines[fences[1] + 1 :])


def brute(text):
    block, body = split(text)
    row = read_block(block) if block is not None else None
    return (*row[:5], body, row[5]) if row else (None, None, None, False, False, text or "", "{}")


TEXTS = [
    None, "", "no block", "---", "---\n", "---\n---", "---\n---\nbody", "\n \n---\nname: A b\n---\nbody\n---\nmore", "---\nname: A\ndescription: d e, f\nmetadata:\n  type: user\n---\n", "---\nmetadata:\n  type: user\n  other: x y\nname: N\n---\nb",
    "---\nname: yes\n---\nx", "---\nname: 7\n---\nx", "---\nname: 'quoted'\n---\nx", "---\nname: a: b\n---\nx", "---\nname: a #b\n---\nx", "---\n- a\n- b\n---\nx", "---\nname: [1, 2\n---\nx", "---\nname: 2020-01-01\n---\nx", "---\nname: >\n  folded\n  text\n---\nx",
    "---\nname: a\nname: b\n---\nx", "---\nmetadata: none\n---\nx", "---\nmetadata:\n---\nx", "x\n---\nname: a\n---\n", " ---  \nname: A\n\t---\nbody", "---\r\nname: A\r\n---\r\nbody", "---\x0bname: A\x0b---\x0bbody", "---\n\nname: A\n\n---\n\n\nbody\n", "---\nname: \n---\nx", "---\nname:\n---\nx",
    "---\nname: Null\ndescription: OFF\n---\nx", "---\nname: naïve\n---\nx", "---\nname: A \n---\nx", "---\nnull: x\n---\nx", "---\nname: A\n--- \nb", "----\nname: A\n---\nb", "\x1f---\nname: A\n---\nb", "---\nname: don't\n---\nb", "---\nmetadata:\n  type: user\n\n  other: a\n---\nb", "---\nyes: a\non: b\n---\nb",
]


def test_all_forms(spark):
    rng = random.Random(1)
    pieces = ["---\n", "name: A\n", "description: some text, here\n", "metadata:\n", "  type: user\n", "\n", " ", "body", "x: true\n", "- a\n", "---"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(400)] + ["---\n" + "".join(rng.choice(pieces[1:6]) for _ in range(rng.randrange(6))) + "---\nb" for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", frontmatter(F.col("t")).alias("m")).collect()
    wrong = [(texts[r["i"]], tuple(r["m"]), brute(texts[r["i"]])) for r in rows if tuple(r["m"]) != brute(texts[r["i"]])]
    assert not wrong, wrong[:3]


def test_plain_blocks_stay_in_the_jvm(spark):
    """What Spark reads itself, YAML reads alike; other blocks are no plain ones."""
    plain = spark.createDataFrame([(split(t)[0],) for t in TEXTS if split(t)[0] is not None], "b string").select("b", F.col("b").rlike(_PLAIN).alias("p")).collect()
    assert sum(r["p"] for r in plain) >= 6
    for r in plain:
        if r["p"]:
            assert isinstance(yaml.safe_load(r["b"]), dict | None)
