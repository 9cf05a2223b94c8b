"""Schemas of the engine's tables."""

NODES = (
    "id string, name string, kind string, path string, start_line int, end_line int, body_hash string, owner string, signature string, "
    "exported boolean, origin string, chars long, body string, summary string, summary_state string, "
    "crux struct<code:string,start_line:int,end_line:int>, ord long"
)
EDGES = "source string, target string, relation string, confidence string, ord long"
RAW_EDGES = (
    "source string, relation string, file string, target_id string, specifier string, name string, imported_name string, "
    "via_member string, recv_type string, scope_id string, file_ord int, seq int"
)
SCOPES = "prefix string, label string, markers array<string>"

#: The closed sets of kinds, relations and confidences.
KINDS = ("file", "class", "function", "method", "interface", "type", "enum", "struct", "trait", "module", "constant", "variable")
RELATIONS = ("contains", "imports", "calls", "extends", "implements", "type_reference")
CONFIDENCES = ("lsp_resolved", "lsp_dispatch", "extracted", "inferred")
#: Relations that no usage metric counts, and those that may point outside the graph.
STRUCTURAL = ("contains", "imports")
MAY_DANGLE = ("imports", "extends", "implements")
