"""Operations of a training-data pipeline; every registered query of them is in ``llm.registry``."""
