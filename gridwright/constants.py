"""Values shared by all operators."""

# Task names, the class/number threshold, seed and fold count.
CLASSIFICATION = "classification"
REGRESSION = "regression"
CARDINALITY_THRESHOLD = 10
SEED = 42
FOLDS = 5

# Undo depth, chart point limits, default histogram bins.
HISTORY_DEPTH = 12
OUTLIER_POINTS = 2500
HISTOGRAM_BINS = 35

# Rows one task may sort or hold for one group; larger groups are split.
GROUP_ROWS = 1_000_000
# Distinct values a single aggregation buffer may hold.
BUFFER_VALUES = 250_000
# Rows a table may have (checked by a count) before it is no longer broadcast.
BROADCAST_ROWS = 100_000
