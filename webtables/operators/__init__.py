"""Table operators: every public function takes DataFrames and returns a lazy DataFrame."""
