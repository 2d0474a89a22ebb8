"""Fixed parameters of the registered queries (the study's configuration values)."""

# Fixed values of the studied configuration.
SEED = 20260802            # split / subset seed
BASELINE_SEED = 20260723   # default seed of the baseline classifier
TEST_SIZE = 0.20
CV_FOLDS = 5
FEATURE_MAPS = ["zz", "pauli", "custom"]
CIRCUIT_REPETITIONS = 2
MAP_REPEATS = 3
SUBSET_SIZES = [16, 32, 64]
REPEATS = 5
C_GRID = [0.1, 1.0, 10.0]
GAMMA_GRID = ["scale", "auto", 0.01]
REMOTE_SUBSET = 8
REMOTE_SHOTS = 200
MAP_STUDY_SEED_OFFSET = 1000   # map study seeds: seed + 1000 + repeat
SIZE_SEED_FACTOR = 100         # comparison seeds: seed + 100 * size + repeat
