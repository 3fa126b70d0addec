"""Pictures of PDF files; needs a decoder that this installation may lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_pdf_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Embedded pictures of PDF files below a path: file, page, sha. Raises where PyMuPDF is not installed."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF, which is not installed") from e
    from collections.abc import Iterator
    from hashlib import sha256

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                doc = fitz.open(stream=content, filetype="pdf")
                for k, page in enumerate(doc):
                    for xref in sorted({x[0] for x in page.get_images(full=True)}):
                        rows.append((name, k + 1, sha256(doc.extract_image(xref)["image"]).hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "page", "sha"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, page int, sha string")
