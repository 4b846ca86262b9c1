"""Explicit schemas of every table that crosses a file boundary.

Positions are columns (`page_num`, `idx`, `chunk_idx`, `q_idx`, `rank`) because Spark rows carry no order.
All positions are dense and start at 0, except `rank`, which starts at 1.
"""

PAGES = "doc STRING, page_num INT, text STRING"
FILES = "folder STRING, name STRING"
DOCS = "title STRING, zip_name STRING, text STRING"
CHUNKS = "title STRING, zip_name STRING, chunk_idx INT, chunk STRING"
EMBEDDED_CHUNKS = CHUNKS + ", embedding ARRAY<FLOAT>"
STORE = "id STRING, chunk STRING, title STRING, zip_name STRING, embedding ARRAY<FLOAT>"
QUESTIONS = "q_idx INT, question STRING"
RESPONSES = "title STRING, q_idx INT, response STRING"
