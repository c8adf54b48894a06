"""What both ways of computing centrality agree on."""

DAMPING = 0.85
ROUNDS = 100
EPSILON = 1e-7

SCORES = "idx bigint, centrality double"
