"""The one exception type callers see, with a stable machine-readable code."""

from __future__ import annotations

# The error codes callers switch on.
CODES = (
    "badArtifact",
    "datasetNotFound",
    "dependenceFailed",
    "duplicateColumns",
    "duplicateScenarios",
    "emptyDataset",
    "emptyTarget",
    "invalidAlgorithm",
    "invalidBinaryTarget",
    "invalidColumns",
    "invalidCsv",
    "invalidEdits",
    "invalidMulticlassTarget",
    "invalidRows",
    "invalidTask",
    "missingTarget",
    "modelNotFound",
    "noFeatures",
    "reservedColumn",
    "rowNotFound",
    "sampleMissing",
    "sharedFolderNotMounted",
    "tooFewRows",
    "tooManyLanguages",
    "unboundedLevels",
    "unknownFeature",
    "vocabularyTooLarge",
    "checkpointDirMissing",
)


class AnalysisError(Exception):
    """Bad input or a missing precondition; ``code`` is one of ``CODES``."""

    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
