"""Names that operators use inside, or return: documents may have columns of the same names."""

INTERNAL = "_toxic _lang _ambiguous _id _sha _cut _none _hot kept row n_removed n_bytes n_spans kept_sha256 sha block class_id class_rows copy was_null toxic language ambiguous place d1 d2 n_shingles component_id score component hashes words w span first_word shingles"
