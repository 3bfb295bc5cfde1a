"""The schemas of records, regions and hits, as DDL."""

RECORD = "file_ord int, ord long, id string, `desc` string, seq string, qual string"
REGION = "bed_ord long, seq_id string, start long, `end` long, name string"
HIT = "file_ord int, ord long, id string, start long, `end` long, matched string, strand string"

#: The columns that give the input order.
ORDER = ("file_ord", "ord")
