"""Training-data operators over text corpora. Nothing outside this folder and corpus_pipeline.py imports them."""
