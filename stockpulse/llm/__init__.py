"""Training-data operators: near-duplicate detection, repeated-passage removal,
URL rules, classifiers, mixing and decontamination over documents tables.

Nothing else in the library imports this package."""
