"""Operations of a training-data pipeline. Nothing else in taxoflux imports this subpackage."""
