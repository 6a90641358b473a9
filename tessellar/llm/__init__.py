"""Training-data operators: one module per operator, all of them Spark jobs over a documents table.

Nothing else in the package imports this subpackage. Shared conventions:

* a document is a row with ``doc_id`` and ``text``; other columns are carried or ignored, never required;
* a null text counts as the empty text, a null ``doc_id`` is an ordinary value that equals only itself;
* words are maximal runs of anything but the six ASCII blanks (0x20, 0x09-0x0D);
* intermediate tables are Parquet in the folder that ``spark.checkpoint.dir`` names (see ``common.keep``).
"""
