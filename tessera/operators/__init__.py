"""Steps that work on whole record sets: expansion, envelopes, vector search, paging."""
