"""Files of annotations: JSON, MessagePack, CSV with a TOML header, and Parquet corpora."""

from cadenza.sources.files import decode_documents, load_corpus, load_lines, read_documents, read_file, read_lines, save_corpus, write_documents, write_file

__all__ = ["decode_documents", "load_corpus", "load_lines", "read_documents", "read_file", "read_lines", "save_corpus", "write_documents", "write_file"]
