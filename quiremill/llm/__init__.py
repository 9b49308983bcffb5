"""Operators that prepare converted documents as training data.

Texts are the library's converted documents (`doc_id`, `text`, as `operators.text.document_text` returns them); raw
inputs are its files (`file_id`, `name`, `mtime`, `content`). Nothing else in the library imports this subpackage.
"""
