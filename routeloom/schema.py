"""Schemas of the entities, as DDL."""

RULES = "rule_idx INT, radius INT, template STRING, native STRING, nb_prod INT, score FLOAT, reaction_id STRING"
RULE_NEED = "rule_idx INT, coord INT, need INT"
RULE_DELTA = "rule_idx INT, coord INT, delta INT"
FINGERPRINT = "mol STRING, coord INT, n INT"
SINK = "skel STRING, mol STRING, label STRING"
RULE_EC = "rule_idx INT, ec ARRAY<STRING>, n_reactions INT, n_unresolved INT"
NEIGHBOUR = "mol STRING, rule_idx INT, molecules ARRAY<STRING>, removed ARRAY<STRING>, ec ARRAY<STRING>, also ARRAY<INT>"
MOLECULE = "run STRING, mol_id LONG, mol STRING, depth INT, available BOOLEAN, expanded BOOLEAN"
REACTION = "run STRING, rxn_id LONG, parent LONG, child LONG, times INT"
DECISION = (
    "policy STRING, target STRING, seed INT, step INT, node_id LONG, mol STRING, depth INT, frontier_size INT, "
    "n_neighbours INT, solved_after BOOLEAN"
)
#: One row of a run table: absent integers are null, an unknown fraction is NaN.
RUN = (
    "policy STRING, target STRING, seed INT, expandable BOOLEAN, solved BOOLEAN, n_expansions INT, solved_at INT, "
    "stopped_because STRING, n_molecules INT, n_reactions INT, n_routes INT, shortest_route INT, reference_route INT, "
    "ec_fraction DOUBLE, elapsed_s DOUBLE, llm_calls INT, llm_input_tokens LONG, llm_output_tokens LONG, llm_fallbacks INT"
)
PAIR = "system STRING, user STRING, assistant STRING, depth INT, n_on_route INT, n_shown INT, n_frontier INT"
ROUTE_TREE = "target STRING, depth INT, tree MAP<STRING, INT>"
PATHWAY = (
    "elements STRUCT<nodes: ARRAY<STRUCT<data: STRUCT<id: STRING, type: STRING, SMILES: STRING, inSink: STRING, isSource: STRING, "
    "`Rule ID`: VARIANT, `EC number`: VARIANT, `Reaction SMILES`: STRING, Diameter: STRING>>>, "
    "edges: ARRAY<STRUCT<data: STRUCT<source: STRING, target: STRING>>>>"
)
EQUATION = "id STRING, equation STRING, reference STRING, classifs STRING, is_balanced STRING"
COMPOUND = "id STRING, name STRING, reference STRING, formula STRING, charge STRING, mass STRING, inchi STRING, inchikey STRING, smiles STRING"
