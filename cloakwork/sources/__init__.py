"""Reading and writing tables, parsing raw payloads, constant catalogues."""
