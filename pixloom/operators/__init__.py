"""Image operators: Catalyst expressions over planes, Arrow kernels over packed bytes, labels and mixing."""
