"""Front-ends that fill the kernel's relations."""
