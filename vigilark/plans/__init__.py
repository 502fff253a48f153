"""Physical building blocks shared by the operators: checked broadcasts, salted joins, distributed ranks."""
