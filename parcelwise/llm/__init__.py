"""Operations for preparing training text and vectors at scale. Nothing else in the library imports this subpackage."""
