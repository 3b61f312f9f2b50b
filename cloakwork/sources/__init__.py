"""Readers and writers: files, docx, lines, word lists, gold samples, OCR providers."""
