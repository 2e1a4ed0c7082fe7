"""Small tables with the awkward cases, and a folder of them that queries can read."""

import shutil
from pathlib import Path

SF = Path("/root/testdata/sf0.001")
HARD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    " one  two \t three\n",
    "a b c a b c",
    "a b a b a b a b",
    "x " * 3000,
    "ÄÖ ß ▁ ▁▁ x  y   z ",
    "<|im_end|>\\<|im_start|>\\\\<\\|",
    "emoji 😀 and \u3000 wide",
    "tail space ",
    "line\nline\nline\n \nother",
]


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(str(path))


def folder(spark, tmp_path, **tables):
    """A copy of the smallest test data in which some tables are replaced by (rows, schema)."""
    for p in SF.glob("*.parquet"):
        if p.stem not in tables:
            shutil.copy(p, tmp_path / p.name)
    for name, (rows, schema) in tables.items():
        write(spark, rows, schema, tmp_path / f"{name}.parquet")
    return str(tmp_path)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(texts):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS
