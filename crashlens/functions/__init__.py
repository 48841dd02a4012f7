"""Column predicates."""

from crashlens.functions.predicates import (NON_GRADES, any_of, grade_above, icontains,
                                            icontains_any, ieq, non_numeric, not_placeholder,
                                            null_or_placeholder)

__all__ = ["NON_GRADES", "any_of", "grade_above", "icontains", "icontains_any", "ieq",
           "non_numeric", "not_placeholder", "null_or_placeholder"]
