"""Relational operators, one public function per operator, DataFrame to DataFrame."""
